"""Exact order statistics of groups of any size, by histograms that get finer around the wanted places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.spread import spread_join
from quern.sources.folders import dropped, kept

BINS = 1024
#: Searches that go to all executors (some 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 100_000


def order_statistics(values: DataFrame, group: list[str], value: str, places: DataFrame, bins: int = BINS) -> DataFrame:
    """group, place, v: the place-th smallest value (from 1) of each group; places: (group, place). Nulls aren't ranked, places beyond a group are left out.

    A round counts the values between two bounds in `bins` bins for every open
    search and moves the bounds to the least and the largest value of the bin
    that holds the place, until they are equal. Counts leave the executors,
    at most `bins` a search; no task orders a group.
    """
    rows = kept(values.select(*group, F.col(value).cast("double").alias("v")).filter("v is not null"), "values")
    span = rows.groupBy(*group).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    first = places.select(*group, "place").distinct().join(span, group).filter("place between 1 and n").select(*group, "place", "low", "high", F.lit(0).cast("long").alias("below"))
    searches = kept(first, "searches", open=F.col("low") < F.col("high"))
    done = [searches.filter("low = high")]
    while searches.counts["open"]:
        going = searches.filter("low < high")
        met = rows.join(F.broadcast(going), group) if going.count() <= BROADCAST_ROWS else spread_join(rows, going, group)
        # Bins follow the order of the values: each step of the formula does.
        place = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int")
        halved = F.when(F.col("v") > F.col("low") / 2 + F.col("high") / 2, 1).otherwise(0)  # where the span itself is beyond a double
        bin_ = F.when((F.col("high") - F.col("low")) == float("inf"), halved).otherwise(place)
        counted = met.filter("v between low and high").groupBy(*group, "place", "below", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy(*group, "place").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
        found = counted.withColumn("upto", F.col("below") + upto).filter((F.col("upto") >= F.col("place")) & (F.col("upto") - F.col("n") < F.col("place")))
        searches = kept(found.select(*group, "place", "low", "high", (F.col("upto") - F.col("n")).alias("below")), "searches", open=F.col("low") < F.col("high"))
        done.append(searches.filter("low = high"))
    dropped(rows)
    return reduce(DataFrame.unionByName, done).select(*group, "place", F.col("low").alias("v"))


def exclusive_quartiles(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, n, q1, q3 by the exclusive method: place i(n+1)/4 between neighbours. Null for a group of one row; null values and groups have none."""
    values = values.select(*group, value).dropna()
    sizes = kept(values.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), "sizes")

    def lower(i: int) -> Column:
        return F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(i * (F.col("n") + 1) / 4))).cast("long")

    wanted = sizes.select(*group, F.explode(F.array(lower(1), lower(1) + 1, lower(3), lower(3) + 1)).alias("place"))
    told = order_statistics(values, group, value, wanted)

    def q(i: int) -> Column:
        over = i * (F.col("n") + 1) - 4 * lower(i)
        at = lambda p: F.element_at("at", p)
        return ((at(lower(i)) * (4 - over) + at(lower(i) + 1) * over) / 4).alias(f"q{i}")

    by_place = told.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("at"))  # four places a group
    return sizes.join(by_place, group).select(*group, "n", q(1), q(3))
