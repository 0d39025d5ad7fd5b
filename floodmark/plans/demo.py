"""Weekly positions, prices and bars as projections of the given tables.

The series of a demo is a region of the suppliers (positions) or customers
(prices), or a type of events (bars). ``series='l_suppkey'`` gives positions by
supplier for runs with many series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins as J
from ..operators import windows as W

LAST_DATE = "2001-07-31"
TRAIN_END, TEST_START = "1998-12-31", "1999-01-01"
FACTORS = ("mm_pct", "producer_pct", "swap_pct", "oi_pct")
HORIZONS = (1, 2, 4, 8)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    """nationkey to series_id: 25 rows, broadcast by the optimizer from its size."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("series_id"))


def positions(spark: SparkSession, sf: str, series: str = "region") -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    date = F.date_add(F.date_trunc("week", "l_shipdate").cast("date"), 1)
    q = F.col("l_quantity")
    flag = lambda f: F.col("l_returnflag") == f
    status = lambda s: F.col("l_linestatus") == s
    part = lambda c: F.sum(F.when(c, q).otherwise(0.0))
    if series == "region":
        s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
        # a partial sum by supplier and week first: the join then sees few rows
        li = li.join(s, li.l_suppkey == s.s_suppkey).join(_regions(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
        key = F.col("series_id")
    else:
        key = F.concat(F.lit("S"), F.col(series).cast("string"))
    out = li.groupBy(key.alias("series_id"), date.alias("date")).agg(
        part(flag("A")).alias("mm_long"), part(flag("R")).alias("mm_short"),
        part(status("O")).alias("producer_long"), part(status("F")).alias("producer_short"),
        part(flag("N") & status("O")).alias("swap_long"), part(flag("N") & status("F")).alias("swap_short"),
        F.sum(q).alias("oi"),
    )
    return out.filter(F.col("date") <= F.lit(LAST_DATE).cast("date"))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(_regions(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("series_id", F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").alias("volume"),
    )


def alt_prices(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(s, li.l_suppkey == s.s_suppkey).join(_regions(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100)  # whole numbers add up alike in any order
    return rows.groupBy("series_id", F.to_date("l_shipdate").alias("date")).agg((F.sum(cents) / F.count("*") / 100).alias("alt_close"))


def net(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{k}_net": F.col(f"{k}_long") - F.col(f"{k}_short") for k in ("mm", "producer", "swap")})


def master(spark: SparkSession, sf: str) -> DataFrame:
    """Positions with nets and the last close on or before each date."""
    left = net(positions(spark, sf))
    right = prices(spark, sf).select("series_id", "date", "close")
    return J.asof(left, right, ["close"]).filter(F.col("close").isNotNull())


def weekly(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """The weekly master (or base, if it was written before) with returns, percentiles, z-scores, split and regime."""
    w = W.by_series()
    df = master(spark, sf) if base is None else base
    df = W.trailing_returns(df)
    df = W.forward_returns(df)
    df = df.withColumns({f"{k}_pct": W.percentile(c, 156, 52, w) for k, c in (("mm", "mm_net"), ("producer", "producer_net"), ("swap", "swap_net"), ("oi", "oi"), ("close", "close"))})
    df = df.withColumns({f"{k}_z": W.zscore(c, n, m, w) for k, c, n, m in (("r1", "r1", 52, 26), ("mm", "mm_net", 156, 52), ("oi", "oi", 156, 52), ("close", "close", 156, 52))})
    return df.withColumns({"split": C.sample_split("date", TRAIN_END, TEST_START), "regime": W.price_regime("close", w)})


def structure(spark: SparkSession, sf: str, base: DataFrame | None = None) -> DataFrame:
    """Prior percentiles of longs, shorts and nets, their velocities, 8-week changes and states."""
    w = W.by_series()
    df = W.trailing_returns(master(spark, sf) if base is None else base)
    sides = ("long", "short", "net")
    df = df.withColumns({f"{s}_pct": W.prior_percentile(f"mm_{s}", 156, 20, w) for s in sides})
    df = W.velocities(df, [f"{s}_pct" for s in sides], (2, 4, 8, 12, 26))
    df = df.withColumns({f"{s}_change8": F.col(f"mm_{s}") - F.lag(f"mm_{s}", 8).over(w) for s in sides})
    df = df.withColumn("structure_state", C.structure_state("long_pct", "short_pct", "net_pct", "long_pct_v8", "short_pct_v8", "net_pct_v8"))
    return df.withColumns({"contribution_state": C.contribution_state("long_change8", "short_change8"), "split": C.sample_split("date", TRAIN_END, TEST_START)})


def lifecycle(spark: SparkSession, sf: str, frame: DataFrame | None = None) -> DataFrame:
    df = W.velocities(weekly(spark, sf) if frame is None else frame, ["mm_pct"], (4, 8, 12, 26))
    w = W.by_series()
    df = df.withColumn("mm_accel8", F.col("mm_pct_v8") - F.lag("mm_pct_v8", 8).over(w))
    return df.withColumn("lifecycle_state", C.lifecycle_state("mm_pct", "mm_pct_v8"))


def bars(spark: SparkSession, sf: str, unit: str = "hour") -> DataFrame:
    """Bars of events: hourly (bar_start) or daily (date); the price is the value, in the order of time and id."""
    e = table(spark, sf, "events").select("event_type", "ts", "event_id", "value")
    order = F.struct("ts", "event_id")
    at = F.date_trunc("hour", "ts").alias("bar_start") if unit == "hour" else F.to_date("ts").alias("date")
    return e.groupBy(F.col("event_type").alias("series_id"), at).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").alias("volume"),
    )


def definitions(spark: SparkSession, sf: str, factors: tuple[str, ...] = ("mm_net", "producer_net", "oi")) -> DataFrame:
    """Each factor under several definitions: {factor}__{definition}; prior windows, and the whole history."""
    w = W.by_series()
    df = W.forward_returns(W.trailing_returns(master(spark, sf)))
    made = {}
    for f in factors:
        made |= {f"{f}__p{n}": W.prior_percentile(f, n, 52, w) for n in (52, 104, 156)}
        made |= {f"{f}__z{n}": W.zscore(f, n, 52, w, prior=True) for n in (52, 156)}
    df = df.withColumns(made)
    for f in factors:
        df = W.full_history_percentile(df, f, f"{f}__full")
    return df.withColumn("split", C.sample_split("date", TRAIN_END, TEST_START))
