"""Outcome tables, rank correlations and comparisons over long rows (keys, x, y).

Everything is grouped by keys that hold the series, so exact medians keep small
buffers; pooled statistics over all series are the same calls with fewer keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import decile_floor, ratio
from .windows import average_rank, forward, forward_drawdown


def pairs(df: DataFrame, features: Mapping[str, str], returns: Mapping[int, str], keep: Sequence[str], extra: Mapping[int, str] | None = None) -> DataFrame:
    """keep, feature, horizon, x, y (and z of extra): one row for each feature and horizon, nulls kept."""
    f = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).cast("double").alias("x")) for n, c in features.items()]))
    fields = lambda h, c: [F.lit(h).alias("horizon"), F.col(c).alias("y"), *([F.col(extra[h]).alias("z")] if extra else [])]
    r = F.explode(F.array(*[F.struct(*fields(h, c)) for h, c in returns.items()]))
    long = df.select(*keep, *dict.fromkeys([*returns.values(), *(extra or {}).values()]), f.alias("__f")).select(*keep, "__f.*", r.alias("__r"))
    return long.select(*keep, "feature", "x", "__r.*")


def solid(df: DataFrame) -> DataFrame:
    return df.filter("x is not null and y is not null")


def scaffold(df: DataFrame, keys: Sequence[str], name: str, values: Sequence) -> DataFrame:
    """Every value for each of the keys that df holds."""
    return df.select(*keys).distinct().withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def win(y: str = "y") -> Column:
    return F.avg((F.col(y) > 0).cast("double"))


def bucket_stats(long: DataFrame, keys: Sequence[str], bucket: Column, extremes: bool = False, drawdown: bool = False) -> DataFrame:
    """keys, bucket 1..10: count, mean, median and win rate of y; all ten buckets come out."""
    rows = long.filter("x is not null").withColumn("bucket", bucket)
    aggs = [F.count("y").alias("n"), F.avg("y").alias("avg"), F.median("y").alias("median"), F.avg(F.when(F.col("y").isNotNull(), (F.col("y") > 0).cast("double"))).alias("win")]
    aggs += [F.max("y").alias("best"), F.min("y").alias("worst")] if extremes else []
    aggs += [F.min("z").alias("drawdown")] if drawdown else []
    found = rows.groupBy(*keys, "bucket").agg(*aggs)
    return scaffold(long, keys, "bucket", range(1, 11)).join(found, [*keys, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def factor_study(df: DataFrame, factors: Mapping[str, str], price: str, horizons: Sequence[int], part: Sequence[str], date: str = "date") -> DataFrame:
    """pairs of factors with forward returns and drawdowns, both taken within part (a segment's rows follow one another)."""
    w = Window.partitionBy(*part).orderBy(date)
    df = df.withColumns({f"__y{h}": forward(price, h, w) for h in horizons} | {f"__z{h}": forward_drawdown(price, h, w) for h in horizons})
    return pairs(df, factors, {h: f"__y{h}" for h in horizons}, [*part, date], {h: f"__z{h}" for h in horizons})


def state_outcomes(df: DataFrame, keys: Sequence[str], state: str, states: Sequence[str], returns: Sequence[str]) -> DataFrame:
    """For each state: rows, and of each return mean, median and win rate; best and worst of the last."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for r in returns:
        aggs += [F.avg(r).alias(f"avg_{r}"), F.median(r).alias(f"median_{r}"), F.avg(F.when(F.col(r).isNotNull(), (F.col(r) > 0).cast("double"))).alias(f"win_{r}")]
    aggs += [F.max(returns[-1]).alias("best"), F.min(returns[-1]).alias("worst")]
    found = df.groupBy(*keys, state).agg(*aggs)
    return scaffold(df, keys, state, states).join(found, [*keys, state], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _corr(x: str, y: str) -> Column:
    """Pearson correlation; null where x or y has one value (corr would divide by zero)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(long: DataFrame, keys: Sequence[str], least: int = 5) -> DataFrame:
    """keys: n, pearson and spearman of x and y; null below least rows or where x or y has one value only."""
    rows = solid(long).withColumns({"__rx": average_rank("x", keys), "__ry": average_rank("y", keys)})
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("__p"), _corr("__rx", "__ry").alias("__s"),
        (F.min("x") < F.max("x")).alias("__vx"), (F.min("y") < F.max("y")).alias("__vy"),
    )
    fine = (F.col("n") >= least) & F.col("__vx") & F.col("__vy")
    return out.select(*keys, "n", F.when(fine, F.col("__p")).alias("pearson"), F.when(fine, F.col("__s")).alias("spearman"))


def correlations_by_series(long: DataFrame, keys: Sequence[str], least: int = 5) -> DataFrame:
    """correlations for very many pairs of keys: no window, all ranks of a group in one vectorised task."""
    fields = [long.schema[k] for k in keys]
    out = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("pearson", T.DoubleType()), T.StructField("spearman", T.DoubleType())])

    def one(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, y = part["x"], part["y"]
        p = s = None
        if len(part) >= least and x.nunique() > 1 and y.nunique() > 1:
            p, s = np.corrcoef(x, y)[0, 1], np.corrcoef(x.rank(), y.rank())[0, 1]
        return pd.DataFrame([[*name, len(part), p, s]], columns=out.names)

    made = solid(long).select(*keys, "x", "y").groupBy(*keys).applyInPandas(one, out)
    return made.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("pearson", "spearman")})


def lead_lag(df: DataFrame, features: Mapping[str, str], returns: Mapping[int, str], lags: Sequence[int], series: Sequence[str], date: str = "date") -> DataFrame:
    """series, feature, horizon, lag: correlations of the feature lag rows before with the return (negative: after)."""
    w = Window.partitionBy(*series).orderBy(date)
    moved = {(n, k): F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w) for n, c in features.items() for k in lags}
    wide = df.select(*series, date, *returns.values(), *[c.alias(f"{n}@{k}") for (n, k), c in moved.items()])
    long = pairs(wide, {f"{n}@{k}": f"`{n}@{k}`" for n, k in moved}, returns, [*series])
    out = correlations(long, [*series, "feature", "horizon"])
    return out.withColumns({"lag": F.split("feature", "@")[1].cast("int"), "feature": F.split("feature", "@")[0]})


def change_stats(df: DataFrame, features: Mapping[str, str], keys: Sequence[str], date: str = "date") -> DataFrame:
    """keys, feature: coverage, values, and mean, median, p95, sample and population deviation of the absolute change; changes above 0.3; floor deciles in use."""
    long = pairs(df.withColumn("__one", F.lit(0)), features, {0: "__one"}, [*keys, date])
    w = Window.partitionBy(*keys, "feature").orderBy(date)
    x = long.withColumn("c", F.abs(F.col("x") - F.lag("x", 1).over(w)))
    return x.groupBy(*keys, "feature").agg(
        ratio(F.count("x"), F.count(F.lit(1))).alias("coverage"), F.count("x").alias("n"), F.avg("c").alias("change_avg"), F.median("c").alias("change_median"), F.percentile("c", 0.95).alias("change_p95"),
        F.stddev_samp("c").alias("change_sd"), F.stddev_pop("c").alias("change_sd_pop"), F.count_if(F.col("c") > 0.3).alias("jumps"), F.count_distinct(decile_floor("x")).alias("deciles"),
    )


def quantile_spread(long: DataFrame, keys: Sequence[str], low: float = 0.2, high: float = 0.8, least: int = 20) -> DataFrame:
    """keys: median y of rows at or above the high quantile of x less that of rows at or below the low one."""
    rows = solid(long).withColumn("x", F.round("x", 9))  # so that the last bits of a share do not decide
    q = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.round(F.percentile("x", low), 9).alias("__lo"), F.round(F.percentile("x", high), 9).alias("__hi"))
    both = rows.join(q, list(keys)).groupBy(*keys).agg(F.first("__n").alias("__n"), F.median(F.when(F.col("x") >= F.col("__hi"), F.col("y"))).alias("__a"), F.median(F.when(F.col("x") <= F.col("__lo"), F.col("y"))).alias("__b"))
    return both.select(*keys, F.when(F.col("__n") >= least, F.col("__a") - F.col("__b")).alias("spread"))


def monotonicity(means: DataFrame, keys: Sequence[str], least: int = 4) -> DataFrame:
    """keys: rank correlation of bucket numbers with their mean y, over buckets that have one."""
    rows = means.filter("avg is not null").select(*keys, F.col("bucket").cast("double").alias("x"), F.col("avg").alias("y"))
    return correlations(rows, keys, least).select(*keys, F.col("spearman").alias("monotonicity"))


def tails(rows: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """keys: rows, mean and win rate of y in the first and last bucket, their difference and its Welch statistic."""
    b = rows.withColumn("__b", bucket)
    low, high = F.when(F.col("__b") == 1, F.col("y")), F.when(F.col("__b") == 10, F.col("y"))
    out = b.groupBy(*keys).agg(
        F.count(low).alias("n_low"), F.count(high).alias("n_high"), F.avg(low).alias("avg_low"), F.avg(high).alias("avg_high"), F.var_samp(low).alias("__vl"), F.var_samp(high).alias("__vh"),
        F.avg((low > 0).cast("double")).alias("win_low"), F.avg((high > 0).cast("double")).alias("win_high"),
    )
    v = F.try_divide("__vh", "n_high") + F.try_divide("__vl", "n_low")
    fine = (F.col("n_low") >= 2) & (F.col("n_high") >= 2) & (v > 0)
    return out.withColumns({"tail_spread": F.col("avg_high") - F.col("avg_low"), "tail_t": F.when(fine, F.try_divide(F.col("avg_high") - F.col("avg_low"), F.sqrt(v)))}).drop("__vl", "__vh")
