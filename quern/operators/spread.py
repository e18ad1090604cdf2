"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of a key are split into.
SLOTS = 32


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", slots: int = SLOTS) -> DataFrame:
    """rows joined with table on `keys`; rows of a key are split by a hash of the row.

    table holds few rows a key; each goes to the slots that the key's rows
    really use, so that a key met once isn't copied. Keys are never null.
    rows should be a table, as it is read twice.
    """
    dealt = rows.withColumn("_slot", F.pmod(F.xxhash64(*rows.columns), F.lit(slots)).cast("int"))
    near = dealt.select(*keys, "_slot").distinct().join(table, keys)
    return dealt.join(near, [*keys, "_slot"], how).drop("_slot")
