"""Positions of rows within their key without a window over a key, so that a hot key is no hot task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

_BITS = 33  # of the place within a partition, in monotonically_increasing_id


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, count: str | None = None) -> DataFrame:
    """df with the position (from 0) of each row among the rows of its keys, nulls first, and their count if a name for it is given.

    Rows are dealt out by range of (keys, order), so a key of any size is spread over
    tasks; each row's place is written down with it, and a small table of the first
    place and the rows of each key in each partition makes places into positions.
    Rows that are equal in keys and order are spread too; which of them comes first
    is decided once, when they are written.
    Keys must not be null. An empty table gives an empty one.
    """
    tie, place = "__tie", "__place"
    spread = df.withColumn(tie, F.monotonically_increasing_id())
    rows = stored(spread.orderBy(*keys, *order, tie).drop(tie).withColumn(place, F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(place, _BITS).alias("__part")
    parts = rows.groupBy(*keys, part).agg(F.min(place).alias("__first"), F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*keys)
    before = F.sum("__n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*keys, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(own).alias("__all"))
    out = rows.withColumn("__part", part).join(parts, [*keys, "__part"])
    more = [F.col("__all").cast("long").alias(count)] if count else []
    return out.select(*df.columns, (F.col(place) + F.col("__shift")).cast("long").alias(position), *more)


def kept_numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], position: str, count: str | None = None) -> DataFrame:
    """numbered, written as a table of its own; what stood between is removed."""
    found = numbered(df, keys, order, position, count)
    out = stored(found, "numbered")
    drop_stored(found)
    return out
