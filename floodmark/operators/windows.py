"""Per-series window operators. Every function takes a DataFrame, returns one, and keeps one partitioning by series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio
from ..functions.counts import window_shares

SERIES, DATE = ("series_id",), "date"


def by_series(series: Sequence[str] = SERIES, date: str = DATE) -> WindowSpec:
    return Window.partitionBy(*series).orderBy(date)


def trailing(x: str, k: int, w: WindowSpec) -> Column:
    return ratio(F.col(x), F.lag(x, k).over(w)) - 1


def forward(x: str, k: int, w: WindowSpec) -> Column:
    return ratio(F.lead(x, k).over(w), F.col(x)) - 1


def trailing_returns(df: DataFrame, x: str = "close", ks: Sequence[int] = (1, 2, 4, 8), prefix: str = "r", series: Sequence[str] = SERIES) -> DataFrame:
    w = by_series(series)
    return df.withColumns({f"{prefix}{k}": trailing(x, k, w) for k in ks})


def forward_returns(df: DataFrame, x: str = "close", ks: Sequence[int] = (1, 2, 4, 8), prefix: str = "f", series: Sequence[str] = SERIES) -> DataFrame:
    w = by_series(series)
    return df.withColumns({f"{prefix}{k}": forward(x, k, w) for k in ks})


def changes(df: DataFrame, cols: Sequence[str], k: int = 1, series: Sequence[str] = SERIES) -> DataFrame:
    w = by_series(series)
    return df.withColumns({f"{c}_change": F.col(c) - F.lag(c, k).over(w) for c in cols})


def zscore(x: str, window: int, least: int, w: WindowSpec, prior: bool = False) -> Column:
    """(x - mean) / sample deviation of the last window rows, this one included unless prior; null if flat or too short."""
    f = w.rowsBetween(-window, -1) if prior else w.rowsBetween(1 - window, 0)
    sd = F.stddev_samp(x).over(f)
    return F.when((F.count(x).over(f) >= least) & (sd > 1e-12), F.round((F.col(x) - F.avg(x).over(f)) / sd, 12))  # the last bits of a sum depend on its order


def percentile(x: str, window: int, least: int, w: WindowSpec) -> Column:
    """Share of the window's values, this row included, that do not exceed its last value that is not null."""
    a = F.collect_list(x).over(w.rowsBetween(1 - window, 0))
    return F.when(F.size(a) >= least, ratio(F.size(F.filter(a, lambda v: v <= F.element_at(a, -1))), F.size(a)))


def prior_percentile(x: str, window: int, least: int, w: WindowSpec) -> Column:
    """Share of the values of the window rows before that do not exceed this one."""
    a = F.collect_list(x).over(w.rowsBetween(-window, -1))
    return F.when(F.col(x).isNotNull() & (F.size(a) >= least), ratio(F.size(F.filter(a, lambda v: v <= F.col(x))), F.size(a)))


def average_rank(x: str | Column, part: Sequence[str], descending: bool = False) -> Column:
    """Rank among the rows of part; equal values share the mean of their ranks. Rows with null need filtering before."""
    c = F.col(x) if isinstance(x, str) else x
    first = F.rank().over(Window.partitionBy(*part).orderBy(c.desc() if descending else c.asc()))
    return first + (F.count(F.lit(1)).over(Window.partitionBy(*part, c)) - 1) / 2.0


def percent_rank_average(x: str, part: Sequence[str], descending: bool = False) -> Column:
    """average_rank over the number of values; null for null."""
    c = F.col(x)
    present = Window.partitionBy(*part, c.isNull())
    first = F.rank().over(present.orderBy(c.desc() if descending else c.asc()))
    peers = F.count(F.lit(1)).over(Window.partitionBy(*part, c))
    return F.when(c.isNotNull(), (first + (peers - 1) / 2.0) / F.count(F.lit(1)).over(present))


def full_history_percentile(df: DataFrame, x: str, out: str, series: Sequence[str] = SERIES) -> DataFrame:
    return df.withColumn(out, percent_rank_average(x, series))


def price_regime(x: str, w: WindowSpec) -> Column:
    """bull, bear, range or unclassified by the 52-row mean and the 26-row return."""
    f = w.rowsBetween(-51, 0)
    mean = F.when(F.count(x).over(f) >= 26, F.avg(x).over(f))
    r = trailing(x, 26, w)
    return F.when(mean.isNull() | r.isNull(), "unclassified").when((F.col(x) > mean) & (r > 0.05), "bull").when((F.col(x) < mean) & (r < -0.05), "bear").otherwise("range")


def velocities(df: DataFrame, cols: Sequence[str], ks: Sequence[int], series: Sequence[str] = SERIES) -> DataFrame:
    """col_v{k}: the change over k rows."""
    w = by_series(series)
    return df.withColumns({f"{c}_v{k}": F.col(c) - F.lag(c, k).over(w) for c in cols for k in ks})


def forward_drawdown(x: str, h: int, w: WindowSpec) -> Column:
    """Worst fall from a running peak within this row and the h after it; null if one of them is missing."""
    a = F.collect_list(x).over(w.rowsBetween(0, h))
    start = F.struct(F.lit(float("-inf")).alias("peak"), F.lit(0.0).alias("worst"))

    def step(s: Column, v: Column) -> Column:
        peak = F.greatest(s["peak"], v)
        return F.struct(peak.alias("peak"), F.least(s["worst"], v / peak - 1).alias("worst"))

    return F.when(F.size(a) == h + 1, F.aggregate(a, start, step)["worst"])


def normalized_index(x: str, w: WindowSpec) -> Column:
    return ratio(F.col(x), F.first(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) * 100


def rank_decile_rows(df: DataFrame, x: str, part: Sequence[str], tie: Sequence[str], out: str) -> DataFrame:
    """Ten buckets of equal numbers of rows by (x, tie); null where fewer than two values differ."""
    from ..functions.columns import rank_decile

    own = Window.partitionBy(*part, F.col(x).isNull())
    r = F.row_number().over(own.orderBy(x, *tie))
    varied = F.min(x).over(own) < F.max(x).over(own)
    return df.withColumn(out, F.when(F.col(x).isNotNull() & varied, rank_decile(r, F.count(x).over(own))))


def paths(df: DataFrame, x: str, length: int, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """series, start_date, date and path (length + 1 values) for each row with so many values before it; nulls are stepped over."""
    w = by_series(series, date).rowsBetween(-length, 0)
    solid = df.filter(F.col(x).isNotNull()).select(*series, date, F.collect_list(x).over(w).alias("path"), F.min(date).over(w).alias("start_date"))
    return solid.filter(F.size("path") == length + 1)


def long_window_percentile(df: DataFrame, x: str, windows: dict[str, int], least: int, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """prior_percentile for several or long windows at once, a series in a task; sliding.sliding_percentiles cuts series that are too long for that."""
    fields = [*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in windows]]

    sizes = {c: (n, False) for c, n in windows.items()}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(date, kind="stable")
        return part.assign(**window_shares(part[x].to_numpy(dtype=float, na_value=np.nan), sizes, least))

    made = df.groupBy(*series).applyInPandas(run, T.StructType(fields))
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in windows})


def in_chunks(df: DataFrame, rows: int, halo: int, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """df with chunk and is_halo: a long series in pieces of rows rows, each with the halo rows before it.

    Windows of up to halo + 1 rows may then be taken by (series, chunk); rows with
    is_halo are dropped afterwards. Row numbers come from per-day counts, so that
    no task holds a whole series: days of a series are few, rows are many.
    """
    day = F.to_date(date)
    counts = df.groupBy(*series, day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*series).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*series, "__day", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(*series, "__day").orderBy(date))
    n = df.withColumn("__day", day).join(counts, [*series, "__day"]).withColumn("__pos", F.col("__before") + within - 1)
    home = F.floor(F.col("__pos") / rows)
    dealt = F.when(F.col("__pos") % rows >= rows - halo, F.array(home, home + 1)).otherwise(F.array(home))
    out = n.withColumn("__home", home).withColumn("chunk", F.explode(dealt))
    return out.withColumn("is_halo", F.col("chunk") != F.col("__home")).drop("__day", "__before", "__pos", "__home")


