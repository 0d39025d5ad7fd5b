"""Similar states, similar paths and events of each series."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import stored
from .windows import DATE, SERIES, by_series, paths


def similar_states(df: DataFrame, features: Sequence[str], *, top: int | None = 20, skip: int = 52, keep: Sequence[str] = (), series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """The top rows (all candidates if None) of each series that are nearest to its last complete row, the last skip rows before it left out.

    Distance is the sum of absolute differences in points, 300 of them make a score
    of 0. Rows are ranked by the score rounded half up to ten places, then by date.
    """
    whole = Window.partitionBy(*series)
    full = F.lit(True)
    for f in features:
        full = full & F.col(f).isNotNull()
    rows = df.withColumn("__pos", F.row_number().over(by_series(series, date))).filter(full)
    now = F.max(F.struct("__pos", *features)).over(whole)
    rows = rows.withColumn("__now", now).filter(F.col("__pos") < F.col("__now.__pos") + 1 - skip)
    distance = sum((F.abs(F.col(f) - F.col(f"__now.{f}")) * 100 for f in features), F.lit(0.0))
    rows = rows.withColumn("distance", distance).withColumn("score", 100 - F.least(F.greatest(F.col("distance") / 300 * 100, F.lit(0.0)), F.lit(100.0)))
    key = F.floor(F.col("score") * 1e10 + 0.5)
    rank = F.row_number().over(Window.partitionBy(*series).orderBy(key.desc(), F.col(date)))
    rows = rows.withColumn("rank", rank)
    return (rows if top is None else rows.filter(F.col("rank") <= top)).select(*series, "rank", date, "score", "distance", *features, *keep)


def _near_pairs(asked: DataFrame, rows: DataFrame, features: Sequence[str], radius: float) -> DataFrame:
    """Pairs of asked (query, features) and rows (found, features, ...) of other series in the same cell of a grid, or in one beside it in any direction, with their distance in points.

    Cells are radius wide, so no pair with a sum of differences up to radius is left out.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.array(*[F.lit(k) for k in step]) for step in itertools.product((-1, 0, 1), repeat=len(features))])
    beside = F.transform(steps, lambda k: F.array(*[cell(f) + k[i] for i, f in enumerate(features)]))
    asks = asked.select("query", F.struct(*features).alias("__q"), F.explode(beside).alias("__cell"))
    pairs = asks.join(rows.withColumn("__cell", F.array(*[cell(f) for f in features])), "__cell").filter("query <> found")
    distance = sum((F.abs(F.col(f) - F.col(f"__q.{f}")) for f in features), F.lit(0.0)) * 100
    return pairs.withColumn("distance", distance).drop("__cell", "__q")


def similar_states_across(df: DataFrame, features: Sequence[str], *, top: int = 20, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """The top rows of all other series for the last complete row of each series, exact.

    The queries, one a series, meet only rows of nearby cells of a grid. A query is settled once top rows
    lie within the width of a cell, as every row that near was met; the others go on with
    cells twice as wide, until cells are as wide as the data. The first width expects about twice top rows. Of what a
    task finds for a query only the best rows are shuffled. The driver sees three numbers of the table and one a round.
    """
    name = F.concat_ws("|", *series)
    rows = stored(df.dropna(subset=list(features)).select(name.alias("found"), date, *features), "states")
    asked = stored(rows.groupBy(F.col("found").alias("query")).agg(F.max_by(F.struct(*features), date).alias("f")).select("query", "f.*"), "queries")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.greatest(*[F.max(f) - F.min(f) for f in features], F.lit(0.0)).alias("span")).first()
    span = max(size.span or 0.0, 1e-9)
    radius = span * min(1.0, max(2.0 * top / max(size.n, 1), 1e-9) ** (1 / len(features)))
    key = F.floor((100 - F.least(F.col("distance") / 3, F.lit(100.0))) * 1e10 + 0.5)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(key.desc(), date, "found"))
    out = None
    while True:
        best = stored(_near_pairs(asked, rows, features, radius).withColumn("rank", rank).filter(F.col("rank") <= top), "nearest")
        last = radius >= span
        settled = best.groupBy("query").agg(F.count_if(F.col("distance") <= 100 * radius - 1e-8).alias("k")).filter(F.col("k") >= top).select("query")
        found = best if last else best.join(settled, "query", "left_semi")
        out = found if out is None else out.unionByName(found)
        if last:
            return out.select("query", "found", date, "distance", "rank")
        asked = stored(asked.join(settled, "query", "left_anti"), "queries")
        if asked.isEmpty():
            return out.select("query", "found", date, "distance", "rank")
        radius = min(2 * radius, span)


def nearest_values(df: DataFrame, x: str, *, top: int = 10, skip: int = 8, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """The rows whose x is nearest to that of the last row; none where that is null."""
    whole = Window.partitionBy(*series)
    rows = df.withColumn("__pos", F.row_number().over(by_series(series, date))).withColumn("__n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("__now", F.max_by(F.col(x), F.col("__pos")).over(whole)).filter(F.col(x).isNotNull() & F.col("__now").isNotNull() & (F.col("__pos") <= F.col("__n") - skip))
    d = F.round(F.abs(F.col(x) - F.col("__now")), 10)
    rank = F.row_number().over(Window.partitionBy(*series).orderBy(d, date))
    return rows.withColumns({"distance": d, "rank": rank}).filter(F.col("rank") <= top).select(*series, "rank", date, x, "distance")


def path_score(a: Column, b: Column) -> Column:
    """Similarity 0..100 of two arrays of equal length: root mean square difference and correlation; a constant path has correlation 0."""
    n = F.size(a).cast("double")
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / n
    total = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    off = lambda p: F.transform(p, lambda x: x - mean(p))
    rmse = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / n)
    va, vb = total(off(a), off(a)), total(off(b), off(b))
    flat = (va < 1e-18) | (vb < 1e-18)
    corr = F.when(flat, F.lit(0.5)).otherwise((1 - total(off(a), off(b)) / F.sqrt(F.when(flat, F.lit(1.0)).otherwise(va * vb))) / 2)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - F.least(F.lit(2.0), rmse + corr) / 2)))


def similar_paths(df: DataFrame, x: str, lengths: Sequence[int] = (4, 8, 12, 26), *, top: int = 20, skip_weeks: int = 52, series: Sequence[str] = SERIES, date: str = DATE, vectorised: bool = False) -> DataFrame:
    """For each length the top paths that are most like the last one of their series and end skip_weeks before it."""
    out = None
    for n in lengths:
        p = paths(df, x, n, series, date)
        now = F.max_by("path", date).over(Window.partitionBy(*series))
        last = F.max(date).over(Window.partitionBy(*series))
        p = p.withColumns({"current": now, "__last": last}).filter(F.col(date) <= F.date_sub("__last", 7 * skip_weeks))
        p = _scored(p) if vectorised else p.withColumn("score", path_score(F.col("current"), F.col("path")))
        rank = F.row_number().over(Window.partitionBy(*series).orderBy(F.desc(F.round("score", 9)), date))
        p = p.withColumns({"weeks": F.lit(n), "rank": rank}).filter(F.col("rank") <= top).drop("__last")
        out = p if out is None else out.unionByName(p)
    return out


def _scored(p: DataFrame) -> DataFrame:
    """path_score over whole batches: rows of paths as a matrix."""

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            a, c = np.stack(b["path"].to_numpy()), np.stack(b["current"].to_numpy())
            rmse = np.sqrt(((a - c) ** 2).mean(axis=1))
            x, y = a - a.mean(axis=1, keepdims=True), c - c.mean(axis=1, keepdims=True)
            va, vb = (x * x).sum(axis=1), (y * y).sum(axis=1)
            flat = (va < 1e-18) | (vb < 1e-18)
            corr = np.where(flat, 0.5, (1 - (x * y).sum(axis=1) / np.sqrt(np.where(flat, 1, va * vb))) / 2)
            b["score"] = np.clip(100 * (1 - np.minimum(2, rmse + corr) / 2), 0, 100)
            yield b

    return p.mapInPandas(run, p.withColumn("score", F.lit(0.0)).schema)


def top_groups(cases: DataFrame, returns: Mapping[int, str], sizes: Sequence[int] = (5, 10, 20), series: Sequence[str] = SERIES) -> DataFrame:
    """For the best 5, 10, 20 cases: count, mean, median and win rate of each return, best and worst of the last."""
    rows = cases.withColumn("size", F.explode(F.array(*[F.lit(k) for k in sizes]))).filter("rank <= size")
    aggs = [F.count(F.lit(1)).alias("cases")]
    for h, c in returns.items():
        aggs += [F.avg(c).alias(f"avg{h}"), F.median(c).alias(f"median{h}"), F.avg((F.col(c) > 0).cast("double")).alias(f"win{h}")]
    last = list(returns.values())[-1]
    return rows.groupBy(*series, "size").agg(*aggs, F.max(last).alias("best"), F.min(last).alias("worst"))


def spaced_events(events: DataFrame, gap_days: int = 56, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """Events at least gap_days after the last one kept, from the first on.

    Which event is kept depends on the one before, so the dates of a series are
    folded in order; an array of dates holds what one series has, a few bytes each.
    """
    days = F.array_sort(F.collect_set(F.col(date)))
    none = F.array().cast("array<date>")
    fold = lambda kept, x: F.when((F.size(kept) == 0) | (F.datediff(x, F.element_at(kept, -1)) >= gap_days), F.array_append(kept, x)).otherwise(kept)
    safe = lambda kept, x: F.when(F.size(kept) == 0, F.array(x)).otherwise(fold(F.when(F.size(kept) == 0, F.array(x)).otherwise(kept), x))
    return events.groupBy(*series).agg(F.aggregate(days, none, safe).alias("kept")).select(*series, F.explode("kept").alias(date))


def islands(df: DataFrame, gap_days: int, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """Intervals of dates that are no more than gap_days apart: start, end, number of dates."""
    w = by_series(series, date)
    new = F.coalesce(F.datediff(date, F.lag(date, 1).over(w)) > gap_days, F.lit(True))
    rows = df.withColumn("island", F.sum(new.cast("int")).over(w))
    return rows.groupBy(*series, "island").agg(F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.count(F.lit(1)).alias("n"))
