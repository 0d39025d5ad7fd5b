"""Exact quantiles of groups of any size in bounded memory: selection by narrowing histograms.

The usual exact median keeps every value of a group in one buffer. Here each pass counts the values of the
stretch that holds a wanted rank in BINS bins, keeps the bin with the rank, and goes on
with the least and greatest value in it as the new stretch. A stretch of few values is read out
and sorted; one of equal values is the answer. Bins have equal widths in the first pass, on a
logarithmic scale (of both signs) in the second, and so on by turns, so that steep data narrow
too. One to three passes do for most; buffers hold BINS bins or FEW values of a group.

Defined results: nulls, NaN and infinite values are left out; a group without values has a null; an
empty table gives no rows. Quantiles interpolate as percentile and median do.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import drop_stored, stored

BINS = 1024
FEW = 4096
#: Rows of a table of wanted ranks that may be broadcast (its rows are counted first).
SMALL_TABLE = 20_000


def _scaled(x: Column, low: Column, high: Column, steep: bool) -> Column:
    """A number that does not fall as x rises from low to high, finite for all of them."""
    if not steep:
        return x / 2  # halves, so that the widest stretch is finite
    unit = F.greatest(F.abs(low), F.abs(high)) * 1e-300
    return F.signum(x) * F.log1p(F.abs(x) / F.greatest(unit, F.lit(5e-324)))


def _joined(rows: DataFrame, asks: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    return rows.join(F.broadcast(asks) if n <= SMALL_TABLE else asks, list(keys))


def ranked_values(rows: DataFrame, asks: DataFrame, keys: Sequence[str], *, bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, rank and value: of the values of each group that of the rank (from 0, in ascending order).

    rows: keys (at least one) and x, no nulls. asks: keys, rank, low and high (the least and greatest x of the group).
    """
    own = [*keys, "rank"]
    todo = stored(asks.select(*own, "low", "high", F.lit(0).cast("long").alias("skip"), F.lit(None).cast("long").alias("within")), "ranks")
    parts: list[DataFrame] = []
    for turn in itertools.count():
        # equal ends: that is the value; few values: they are read out
        parts.append(todo.filter("low = high").select(*own, F.col("low").alias("value")))
        left = todo.filter("low < high")
        short, long = left.filter(F.coalesce(F.col("within") <= few, F.lit(False))), left.filter(F.coalesce(F.col("within") > few, F.lit(True)))
        n_short, n_long = short.count(), long.count()
        inside = lambda asked, n: _joined(rows, asked, keys, n).filter("x between low and high")
        if n_short:
            got = inside(short, n_short).groupBy(*own, "skip").agg(F.array_sort(F.collect_list("x")).alias("v"))
            parts.append(stored(got.select(*own, F.element_at("v", (F.col("rank") - F.col("skip") + 1).cast("int")).alias("value")), "ranked"))
        if not n_long:
            break
        low, high = F.col("low"), F.col("high")
        f = lambda v: _scaled(v, low, high, turn % 2 == 1)  # noqa: B023, E731
        share = F.coalesce(F.try_divide(f(F.col("x")) - f(low), f(high) - f(low)), F.lit(0.0))
        bin_ = F.when(F.col("x") == high, bins - 1).otherwise(F.least(F.floor(share * bins), F.lit(bins - 2)))
        counts = inside(long, n_long).groupBy(*own, "skip", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        up_to = F.sum("c").over(Window.partitionBy(*own).orderBy("bin"))
        counts = counts.withColumn("to", F.col("skip") + up_to).filter((F.col("rank") < F.col("to")) & (F.col("rank") >= F.col("to") - F.col("c")))
        todo = stored(counts.select(*own, F.col("a").alias("low"), F.col("b").alias("high"), (F.col("to") - F.col("c")).alias("skip"), F.col("c").alias("within")), "ranks")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quantiles(df: DataFrame, keys: Sequence[str], x: str, wanted: Mapping[str, float], *, bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, n (values) and each wanted quantile by name, for every group of df."""
    value = F.col(x).cast("double")
    # one key that is never null stands for the keys
    group = F.to_json(F.struct(*keys)) if keys else F.lit("")
    rows = stored(df.select(*keys, group.alias("__g"), F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).alias("x")), "values")
    ends = stored(rows.groupBy("__g").agg(*[F.first(k).alias(k) for k in keys], F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "ends")
    at = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in at.values()])))
    asks = ends.filter("n > 0").select("__g", F.explode(ranks).alias("rank"), "low", "high")
    found = ranked_values(rows.filter("x is not null").select("__g", "x"), asks, ["__g"], bins=bins, few=few)
    both = ends.join(found.groupBy("__g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("v")), "__g", "left")

    def between(p: Column) -> Column:
        a, b = F.try_element_at("v", F.floor(p)), F.try_element_at("v", F.ceil(p))
        return F.when(F.floor(p) == F.ceil(p), a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)

    out = stored(both.select(*keys, "n", *[F.when(F.col("n") > 0, between(p)).alias(name) for name, p in at.items()]), "quantiles")
    drop_stored(rows, ends)
    return out
