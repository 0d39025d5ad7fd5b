"""Positions, ranks and as-of joins of series of any length: rows are dealt by range, not by series.

Each function sorts its rows by range (series, then order), writes them with their places,
and settles what crosses the borders of ranges with a table of one row for each series in each
range. A single hot series is thus spread over all tasks; results equal those of the plain
window functions.

Defined results: nulls sort first; series keys may be null; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import stored
from .windows import DATE, SERIES

_BITS = 33  # of the place within a partition, in monotonically_increasing_id
_PLACE, _RANGE = "__place", "__range"


def _laid(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df sorted by range, written, with the place of each row and its range. Equal rows are spread over ranges too."""
    tie = "__tie"
    rows = df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*keys, *order, tie).drop(tie)
    return stored(rows.withColumn(_PLACE, F.monotonically_increasing_id()), "by-range").withColumn(_RANGE, F.shiftright(_PLACE, _BITS))


def _met(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of other of their keys, null keys included."""
    right = other.select(*[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__o{i}"))
    return rows.join(right, same).drop(*[f"__o{i}" for i in range(len(keys))])


def _shifts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, range, shift (position = place + shift) and n, the rows of the keys."""
    own = Window.partitionBy(*keys)
    parts = rows.groupBy(*keys, _RANGE).agg(F.min(_PLACE).alias("__first"), F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(own.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
    return parts.select(*keys, _RANGE, (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__c").over(own).alias("__n"))


def positions(df: DataFrame, order: Sequence[str], out: str, *, series: Sequence[str] = SERIES) -> DataFrame:
    """df with the number (from 0) of each row in its series, in the order given."""
    rows = _laid(df, series, order)
    found = _met(rows, _shifts(rows, series), [*series, _RANGE])
    return found.select(*df.columns, (F.col(_PLACE) + F.col("__shift")).cast("long").alias(out))


def ranks(df: DataFrame, x: str, *, series: Sequence[str] = SERIES, rank: str = "rank", percent: str | None = None) -> DataFrame:
    """df with the average rank of x in its series (equal values share the mean of their ranks), and that over the number of values; null for a null.

    Equal values may fill any number of ranges: the first and last position of a value are
    taken from its runs, one for each range that holds it.
    """
    none = "__none"
    rows = _laid(df.withColumn(none, F.col(x).isNull()), [*series, none], [x])
    keys = [*series, none]
    runs = rows.groupBy(*keys, _RANGE, x).agg(F.min(_PLACE).alias("__a"), F.max(_PLACE).alias("__b"))
    runs = _met(runs, _shifts(rows, keys), [*keys, _RANGE])
    same = Window.partitionBy(*keys, x)
    mean = (F.min(F.col("__a") + F.col("__shift")).over(same) + F.max(F.col("__b") + F.col("__shift")).over(same)) / 2.0 + 1
    runs = runs.select(*keys, _RANGE, x, mean.alias("__mean"), "__n")
    found = _met(rows, runs, [*keys, _RANGE, x])
    more = [F.when(~F.col(none), F.col("__mean") / F.col("__n")).alias(percent)] if percent else []
    return found.select(*df.columns, F.when(~F.col(none), F.col("__mean")).alias(rank), *more)


def asof(left: DataFrame, right: DataFrame, values: Sequence[str], *, within: Column | None = None, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """left with the values of the last right row of its series on or before its date, and right's date as asof_date, as in joins.asof.

    Both sides lie over each other by range; a row takes the last right row of its range before
    it, or else the last one of the ranges before, which are handed over the borders.
    within: a condition on the columns date and asof_date beyond which values are null.
    """
    last = F.struct(F.col(date).alias("d"), *values)
    a = left.select(*series, date, F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(last).schema[0].dataType).alias("__r"), F.lit(1).alias("__side"))
    b = right.select(*series, date, F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), last.alias("__r"), F.lit(0).alias("__side"))
    rows = _laid(a.unionByName(b), series, [date, "__side"])
    # of each series the last right row in each range, and then the last one in the ranges before
    ends = rows.groupBy(*series, _RANGE).agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.col(_PLACE))).alias("__end"))
    before = Window.partitionBy(*series).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*series, _RANGE, F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    own = Window.partitionBy(_RANGE, *series).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__own", F.last("__r", ignorenulls=True).over(own)).filter("__side = 1")
    found = _met(found, carried, [*series, _RANGE]).withColumn("__r", F.coalesce("__own", "__carried"))
    out = found.select("__l.*", *[F.col(f"__r.{v}").alias(v) for v in values], F.col("__r.d").alias("asof_date"))
    if within is None:
        return out
    return out.withColumns({c: F.when(within, F.col(c)) for c in [*values]}).withColumn("asof_date", F.when(within, F.col("asof_date")))
