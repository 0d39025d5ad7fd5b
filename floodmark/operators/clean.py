"""Filters, rejects, merges and duplicates of bars and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import ChecksFailed, remove, scratch, write_observed

NEW_YORK = "America/New_York"
TOLERANCE = 0.0005
PRICES = ("open", "high", "low", "close")


def market_filter(df: DataFrame, exact: str, words: Sequence[str], without: Sequence[str] = (), market: str = "market", file: str = "source_file") -> DataFrame:
    """Of each file the rows of the exact market; where a file has none, those whose name holds all words and none of without."""
    name = F.upper(F.trim(market))
    hit = name == exact.upper()
    loose = F.lit(True)
    for w in words:
        loose = loose & name.contains(w.upper())
    for w in without:
        loose = loose & ~name.contains(w.upper())
    any_exact = F.max(hit.cast("int")).over(Window.partitionBy(file)) == 1
    return df.withColumn("__any", any_exact).filter(F.when(F.col("__any"), hit).otherwise(loose)).drop("__any")


def bar_reason(tol: float = 0.0) -> Column:
    """Why a daily bar is not accepted (null: it is): a close that is no price loses the row, other faults lose open, high and low."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) & (F.col(c) > 0)
    fine = good("open") & good("high") & good("low")
    bounds = (F.col("high") + tol < F.greatest("open", "close", "low")) | (F.col("low") - tol > F.least("open", "close"))
    return F.when(~good("close"), "bad_close").when(~fine, "bad_ohlc").when(bounds, "bounds_inconsistent")


def local(ts: str) -> Column:
    return F.from_utc_timestamp(ts, NEW_YORK)


def hourly_reason(ts: str, start: Column, end: Column) -> Column:
    """The first reason that rejects an hourly bar, null if none does."""
    t = local(ts)
    hour, day = F.hour(t), F.weekday(t)
    outside = (hour == 17) | ((day == 4) & (hour >= 17)) | (day == 5) | ((day == 6) & (hour < 18))
    missing = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    return F.coalesce(
        F.when((F.col(ts) < start) | (F.col(ts) >= end), "outside_capture_window"), F.when(missing, "missing_ohlc"), F.when(F.second(ts) != 0, "not_on_a_minute"),
        F.when(outside, "outside_regular_session"), F.when(bar_reason().isNotNull(), "bounds_inconsistent"),
    )


def session_date(ts: str) -> Column:
    """The session of an hourly bar: from 18:00 in New York on it is the next day's."""
    t = local(ts)
    return F.date_add(F.to_date(t), F.when(F.hour(t) >= 18, 1).otherwise(0))


def bar_end(ts: str, request_end: Column, series: Sequence[str]) -> Column:
    """The nominal end of a bar: an hour on, the end of the request, or the next stamp on a minute, whichever is first."""
    # downwards, so that the frame grows row by row instead of being read anew for each
    w = Window.partitionBy(*series).orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.last(F.when(F.second(ts) == 0, F.col(ts)), ignorenulls=True).over(w)
    return F.least(F.col(ts) + F.expr("interval 1 hour"), request_end, nxt)


def complete_bars(df: DataFrame, ts: str, as_of: str, market_time: Column, series: Sequence[str]) -> DataFrame:
    """Daily bars that are over: of an earlier day in New York, or of today after 17:15 there. The last bar goes if it is not stamped at midnight and is the market's current one or today's."""
    now = F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), NEW_YORK)
    t = local(ts)
    day, today = F.to_date(t), F.to_date(now)
    last = F.lead(ts, 1).over(Window.partitionBy(*series).orderBy(ts)).isNull()
    over = (day < today) | ((day == today) & (F.date_format(now, "HH:mm") >= "17:15"))
    live = last & (F.date_format(t, "HH:mm:ss") != "00:00:00") & (F.coalesce(F.col(ts) == market_time, F.lit(False)) | (day == today))
    return df.withColumns({"__over": over, "__live": live}).filter("__over and not __live").drop("__over", "__live")


def union_latest(parts: Sequence[tuple[int, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """One row for each key of all parts: that of the part with the highest rank."""
    out = None
    for rank, df in parts:
        one = df.withColumn("source_rank", F.lit(rank))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    cols = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*cols), "source_rank").alias("r")).select(*keys, "r.*")


def merge_problems(old: DataFrame, new: DataFrame, keys: Sequence[str], overlap_from: Column, recent_from: Column, start: Column, date: str = "date") -> DataFrame:
    """One row of counts that must be 0 before new bars may be merged: repeated keys, known keys that the overlap lost, invalid recent bars, series that begin cold after start."""
    twice = new.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("repeated"))
    lost = old.filter(F.col(date) >= overlap_from).join(new.select(*keys), list(keys), "left_anti").agg(F.count("*").alias("lost"))
    bad = new.filter(bar_reason().isNotNull() & (F.col(date) >= recent_from)).agg(F.count("*").alias("invalid_recent"))
    series = [k for k in keys if k != date]
    cold = new.groupBy(*series).agg(F.min(date).alias("first")).join(old.select(*series).distinct(), series, "left_anti").filter(F.col("first") > start).agg(F.count("*").alias("cold"))
    kinds = [t.withColumn("__i", F.lit(1)) for t in (twice, lost, bad, cold)]  # one row each
    out = kinds[0]
    for k in kinds[1:]:
        out = out.join(k, "__i")
    return out.drop("__i")


def merge_bars(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with new bars in their place; bad ones of new are left out."""
    good = new.filter(bar_reason().isNull())
    values = [c for c in old.columns if c not in keys]
    both = old.select(*keys, F.struct(*values).alias("o")).join(good.select(*keys, F.struct(*values).alias("n")), list(keys), "full_outer")
    return both.select(*keys, F.coalesce("n", "o").alias("r")).select(*keys, "r.*")


def merge_checked(old: DataFrame, new: DataFrame, keys: Sequence[str], overlap_from: Column, recent_from: Column, start: Column, date: str = "date", *, rejected: str = "raise") -> DataFrame:
    """merge_bars where merge_problems finds nothing; else the whole batch is rejected: ChecksFailed with the counts, or old as it is (rejected="keep").

    Both sides are read once: the counts ride on the write of the merged bars, which are
    published only where all are 0. Series that begin cold are told from what was written.
    """
    spark = old.sparkSession
    values = [c for c in old.columns if c not in keys]
    series = [k for k in keys if k != date]
    bad = bar_reason().isNotNull()
    fresh = new.withColumn("__bad", bad).groupBy(*keys).agg(F.max(F.when(~F.col("__bad"), F.struct(*values))).alias("n"), F.count(F.lit(1)).alias("__k"), F.count_if(F.col("__bad") & (F.col(date) >= recent_from)).alias("__recent"))
    both = old.select(*keys, F.struct(*values).alias("o")).join(fresh, list(keys), "full_outer")
    checks = {"repeated": F.col("__k") > 1, "lost": F.col("__k").isNull() & (F.col(date) >= overlap_from), "invalid_recent": F.col("__recent") > 0}
    path = scratch(spark, "merged-bars")
    rows = both.select(*keys, F.coalesce("n", "o").alias("r"), F.col("o").isNotNull().alias("__old"), "__k", "__recent")
    seen = write_observed(rows, path, checks, drop=["__recent"])
    back = spark.read.schema(rows.drop("__recent").schema).parquet(path)
    first = F.min(F.when(F.col("__k").isNotNull(), F.col(date)))
    cold = back.groupBy(*series).agg(first.alias("first"), F.max("__old").alias("known")).filter(~F.col("known") & (F.col("first") > start)).count()
    found = {n: k for n, k in {**{c: seen[c] for c in checks}, "cold": cold}.items() if k}
    if not found:
        return back.filter("r is not null").select(*keys, "r.*")
    remove(spark, path)
    if rejected == "raise":
        raise ChecksFailed("batch rejected: " + ", ".join(f"{n} {k}" for n, k in found.items()), found)
    return old


def duplicate_bars(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows beyond the first of their key, with kind: identical_duplicate within the tolerance, else conflict."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = {c: F.first(c).over(w) for c in PRICES}
    same = F.lit(True)
    for c in PRICES:
        same = same & (F.abs(F.col(c) - F.col(f"__{c}")) <= TOLERANCE)
    rows = df.withColumns({f"__{c}": x for c, x in first.items()} | {"nth": F.row_number().over(w)})
    return rows.filter("nth > 1").withColumn("kind", F.when(same, "identical_duplicate").otherwise("conflict")).drop(*[f"__{c}" for c in PRICES])


def missing_profile(df: DataFrame) -> DataFrame:
    """column, nulls and share of every column that has nulls: one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot(["__n"], list(df.columns), "column", "nulls")
    return long.filter("nulls > 0").select("column", "nulls", (F.col("nulls") / F.col("__n")).alias("share"))
