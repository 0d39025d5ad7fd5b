"""Queries of versioned tables and of series that one task should not hold, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranges as G
from ..operators import selection, sliding
from ..operators import windows as W
from ..sources.paths import scratch, stored
from ..sources.sinks import clustered
from ..sources.versions import merge_partitions, month_of
from ..streaming import bars as B
from . import demo
from .market import _DIRTY, _NEW, _REASON, KEY, _dirty, _refresh
from .sql import BASE, percentile, prior_percentile, r6
from .studies import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_PX = ["open", "high", "low", "close"]


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    QUERIES[name], ORACLES[name] = run, oracle


# --- committed versions -----------------------------------------------------------


def _versions(s: SparkSession, d: str) -> DataFrame:
    """A history, a refresh, compaction, and the refresh once more: three versions, of which the last stands."""
    old, new = _refresh(s, d)
    table = B.bar_table(s, scratch(s, "bar-versions"))
    table.merge(old.select(*KEY, *_PX), batch=0)
    table.merge(new.select(*KEY, *_PX), batch=1)
    table.compact()
    number = table.merge(new.select(*KEY, *_PX), batch=1)["number"]
    return tidy(table.read().withColumn("version", F.lit(number).cast("long")), [*KEY, "version"], _PX)


_PICK = ", ".join(f"{r6(f'CASE WHEN ok.series_id IS NULL THEN od.{c} ELSE ok.{c} END')} AS {c}" for c in _PX)
add("versioned_bars", _versions, f"{_NEW} SELECT series_id, date, CAST(3 AS BIGINT) AS version, {_PICK} FROM od FULL JOIN ok USING (series_id, date)")


def _touched(s: SparkSession, d: str) -> DataFrame:
    """The version after a refresh, with rewritten: does the row stand in a file of that version?"""
    old, new = _refresh(s, d)
    table = B.bar_table(s, scratch(s, "bar-versions"))
    first = set(table.merge(old.select(*KEY, *_PX), batch=0)["folders"].values())
    known = table.merge(new.select(*KEY, *_PX), batch=1)
    kept = sorted({f.split("/")[1] for f in first & set(known["folders"].values())})  # one folder a version
    of = F.element_at(F.split("file", "/"), -3)
    rows = table.read().select(*KEY, "close", F.col("_metadata.file_path").alias("file"))
    return tidy(rows.withColumn("rewritten", ~of.isin(kept)), [*KEY, "rewritten"], ["close"])


add("partition_merge", _touched, f"{_NEW} SELECT series_id, date, date >= DATE '2000-12-01' AS rewritten, {r6('CASE WHEN ok.series_id IS NULL THEN od.close ELSE ok.close END')} AS close FROM od FULL JOIN ok USING (series_id, date)")


def _replaced(s: SparkSession, d: str) -> DataFrame:
    """The same merge into a plain table by months, of which only those of the refresh are replaced."""
    old, new = _refresh(s, d)
    path = scratch(s, "bars-by-month")
    cols = [*KEY, "close"]
    old.select(*cols, month_of().alias("month")).write.partitionBy("month").parquet(path)
    merge_partitions(path, new.filter(B.bar_reason().isNull()).select(*cols, month_of().alias("month")), [*KEY, "month"], "month")
    return tidy(s.read.parquet(path), KEY, ["close"])


add("partition_overwrite", _replaced, f"{_NEW} SELECT series_id, date, {r6('CASE WHEN ok.series_id IS NULL THEN od.close ELSE ok.close END')} AS close FROM od FULL JOIN ok USING (series_id, date)")


def _deliveries(s: SparkSession, d: str) -> DataFrame:
    """Bars that come as a stream of deliveries (a series and week), each in one file; one with a bad bar is left out whole."""
    path = scratch(s, "bar-deliveries")
    rows = _dirty(s, d).select(*KEY, *_PX, F.date_trunc("week", "date").cast("date").alias("week"))
    rows.repartition(12, "series_id", "week").write.parquet(path)
    return tidy(B.replay_upserts(s, path, unit=["series_id", "week"]), [*KEY, "week"], _PX)


add("stream_upsert_deliveries", _deliveries, f"""{_DIRTY}, w AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week, {_REASON} IS NOT NULL AS bad FROM dirty), u AS (SELECT *, bool_or(bad) OVER (PARTITION BY series_id, week) AS refused FROM w)
SELECT series_id, date, week, {', '.join(f'{r6(c)} AS {c}' for c in _PX)} FROM u WHERE NOT refused""")



def _stream_ends(s: SparkSession, d: str) -> DataFrame:
    """The stamps of hourly_bar_end as a stream: ends come out as the watermark passes them."""
    path = scratch(s, "stamps")
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_trunc("minute", "ts")).otherwise(F.date_trunc("second", "ts"))
    demo.table(s, d, "events").select(F.col("event_type").alias("series_id"), stamp.cast("timestamp").alias("ts")).write.parquet(path)
    return B.replay_bar_ends(s, path, "2024-01-28 00:00:00")


add("stream_bar_ends", _stream_ends, """WITH e AS (SELECT DISTINCT event_type AS series_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS ts FROM events),
b AS (SELECT series_id, ts, least(ts + INTERVAL 1 HOUR, TIMESTAMP '2024-01-28', min(CASE WHEN second(ts) = 0 THEN ts END) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS bar_end, max(ts) OVER () - INTERVAL 10 MINUTE AS past FROM e)
SELECT series_id, ts, bar_end FROM b WHERE bar_end <= past AND ts < past""")

# --- one series over many tasks ---------------------------------------------------


def _ticks(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All events as one series: every second event asks, the others are quotes (one for each instant)."""
    e = demo.table(s, d, "events").select(F.lit("all").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    quotes = e.filter("event_id % 2 = 0").groupBy("series_id", "ts").agg(F.max("value").alias("quote"))
    return e.filter("event_id % 2 = 1"), quotes


def _asof_hot(s: SparkSession, d: str) -> DataFrame:
    near = F.unix_micros("ts") - F.unix_micros("asof_date") <= 60_000_000
    found = G.asof(*_ticks(s, d), ["quote"], within=near, date="ts")
    return tidy(found, ["event_id", "ts", "asof_date"], ["value", "quote"])


_NEAR = "q.ts >= e.ts - INTERVAL 1 MINUTE"
add("asof_hot_series", _asof_hot, f"""WITH q AS (SELECT ts, max(value) AS quote FROM events WHERE event_id % 2 = 0 GROUP BY ALL)
SELECT event_id, e.ts AS ts, CASE WHEN {_NEAR} THEN q.ts END AS asof_date, {r6('value')} AS value, {r6(f'CASE WHEN {_NEAR} THEN quote END')} AS quote FROM (SELECT * FROM events WHERE event_id % 2 = 1) e ASOF LEFT JOIN q ON e.ts >= q.ts""")


def _ranks_hot(s: SparkSession, d: str) -> DataFrame:
    """Average ranks over all order lines as one series: of prices, and of quantities, whose values are few."""
    rows = demo.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).alias("q"), F.lit("all").alias("series_id"))
    rows = G.ranks(rows, "l_extendedprice", rank="price_rank", percent="price_share")
    return tidy(G.ranks(rows, "q", rank="quantity_rank", percent="quantity_share"), ["l_orderkey", "l_linenumber"], ["price_rank", "price_share", "quantity_rank", "quantity_share"])


_AVG = "rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2.0"
add("ranks_hot_series", _ranks_hot, f"""WITH r AS (SELECT l_orderkey, l_linenumber, {_AVG.format(p='1', x='l_extendedprice')} AS p, count(*) OVER () AS n, {_AVG.format(p='l_linenumber < 7', x='l_quantity')} AS q, count(*) OVER (PARTITION BY l_linenumber < 7) AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, {r6('p')} AS price_rank, {r6('p / n')} AS price_share, CASE WHEN l_linenumber < 7 THEN {r6('q')} END AS quantity_rank, CASE WHEN l_linenumber < 7 THEN {r6('q / m')} END AS quantity_share FROM r""")
add("positions_hot_series", lambda s, d: G.positions(demo.table(s, d, "events").select("event_type", "ts", "event_id"), ["ts", "event_id"], "position", series=["event_type"]), "SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS position FROM events")

# --- order statistics ---------------------------------------------------------------


def _sliding_hot(s: SparkSession, d: str) -> DataFrame:
    """Percentiles of each event among the 500 and the 5,000 events before it, all events as one series."""
    rows = demo.table(s, d, "events").select(F.lit("all").alias("series_id"), "ts", "event_id", F.when(F.col("event_id") % 10 > 0, F.round("value", 0)).alias("value"))
    found = sliding.sliding_percentiles(rows, "value", {"p500": 500, "p5000": 5000}, 100, order=["ts", "event_id"])
    return tidy(found, ["event_id"], ["p500", "p5000"])


def _slid(n: int) -> str:
    return f"p{n} AS (SELECT e.event_id, CASE WHEN count(p.v) >= 100 THEN count(*) FILTER (p.v <= e.v) / CAST(count(p.v) AS DOUBLE) END AS p{n} FROM e JOIN e p ON p.pos BETWEEN e.pos - {n} AND e.pos - 1 WHERE e.v IS NOT NULL GROUP BY ALL)"


add("sliding_percentile_hot", _sliding_hot, f"""WITH e AS MATERIALIZED (SELECT event_id, CASE WHEN event_id % 10 > 0 THEN round(value, 0) END AS v, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events), {_slid(500)}, {_slid(5000)}
SELECT event_id, {r6('p500')} AS p500, {r6('p5000')} AS p5000 FROM e LEFT JOIN p500 USING (event_id) LEFT JOIN p5000 USING (event_id)""")


def _pooled(s: SparkSession, d: str) -> DataFrame:
    """Quartiles of prices over all order lines of a flag, and over all of them: groups of any size."""
    rows = demo.table(s, d, "lineitem").select("l_returnflag", "l_extendedprice")
    want = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p99": 0.99}
    one, all_rows = selection.quantiles(rows, ["l_returnflag"], "l_extendedprice", want), selection.quantiles(rows, [], "l_extendedprice", want)
    return tidy(one.unionByName(all_rows.withColumn("l_returnflag", F.lit("all"))), ["l_returnflag"], list(want), ["n"])


_QS = ", ".join(f"{r6(f'quantile_cont(l_extendedprice, {q})')} AS {n}" for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("p99", 0.99)))
add("pooled_quantiles", _pooled, f"SELECT l_returnflag, {_QS}, count(l_extendedprice) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'all', {_QS}, count(l_extendedprice) FROM lineitem")


def _landed_master(s: SparkSession, d: str) -> DataFrame:
    """Windows over the master landed in buckets of its series: one table, no exchange."""
    with clustered(demo.master(s, d), 8) as master:
        w = W.by_series()
        out = master.select(*KEY, W.percentile("mm_net", 156, 52, w).alias("p"), W.prior_percentile("oi", 104, 52, w).alias("prior"), W.trailing("close", 4, w).alias("r4"))
        return stored(tidy(out, KEY, ["p", "prior", "r4"]), "clustered-windows")


add("clustered_windows", _landed_master, f"{BASE} SELECT series_id, date, {r6(percentile('mm_net', 156, 52))} AS p, {r6(prior_percentile('oi', 104, 52))} AS prior, {r6('close / nullif(lag(close, 4) OVER (PARTITION BY series_id ORDER BY date), 0) - 1')} AS r4 FROM master")
