"""Global positions and running sums over an order of all rows, without a task that holds them all.

Rows are dealt by ranges of the order, numbered inside their range, and moved
by what the earlier ranges hold. Only one row a range meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import written


def positions(df: DataFrame, keys: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """df with `_pos`, its 0-based place in ascending order of `keys`, and `_before_<s>` for each of `sums`.

    `keys` should tell rows apart; rows alike in every key get places next to
    each other in no fixed order. Nulls come first. df should be narrow: it is
    written once, so that the ranges stay the same for whoever reads them.
    An empty df gives an empty result.
    """
    ranged = written(df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    per_range = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_sum_{s}") for s in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        F.col("_range").alias("_at"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(earlier), F.lit(0)).alias(f"_s0_{s}") for s in sums],
    )
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.withColumns({"_row": F.row_number().over(inside) - 1} | {f"_in_{s}": F.coalesce(F.sum(s).over(before), F.lit(0)) for s in sums})
    # One row a range: bounded by the number of partitions.
    joined = numbered.join(F.broadcast(offsets), numbered["_range"] == offsets["_at"])
    return joined.select(
        *df.columns,
        (F.col("_n0") + F.col("_row")).cast("long").alias("_pos"),
        *[(F.col(f"_s0_{s}") + F.col(f"_in_{s}")).cast("long").alias(f"_before_{s}") for s in sums],
    )


def places_within(df: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """df with `_place`, a row's 0-based place within its group in ascending order of `keys`, and `_size`, the group's rows.

    Rows are dealt by ranges of group and keys, so a group of a third of all
    rows spans a third of the ranges. Nulls among the keys come first, rows
    alike in all keys stand next to each other in no fixed order; the group
    must not be null. An empty df gives an empty result. df is written once.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = written(tied.repartitionByRange(F.col(group), *order, F.col("_tie")).withColumn("_range", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"))
    # A row for each range that a group has rows in.
    same = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(same.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select(F.col("_range").alias("_at"), F.col(group).alias("_of"), before.alias("_n0"), F.sum("_n").over(same).alias("_size"))
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_range", group).orderBy(*order, "_tie")) - 1)
    joined = numbered.join(offsets, (F.col("_range") == F.col("_at")) & (F.col(group) == F.col("_of")))
    return joined.select(*df.columns, (F.col("_n0") + F.col("_row")).cast("long").alias("_place"), F.col("_size").cast("long"))
