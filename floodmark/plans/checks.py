"""Queries of audits, calendars, stored results and health records, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import quality as Q
from ..operators import similarity as M
from ..sources import readers as R
from ..sources.paths import scratch, stored
from . import demo
from .market import KEY, reports
from .search import CASES, FEATURES, FWD, TOP, cases
from .sql import FULL, PRICES, r6
from .studies import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    QUERIES[name], ORACLES[name] = run, oracle


# --- texts ------------------------------------------------------------------------

_LAG, _CORR = "o_orderkey % 17 - 8", "CASE WHEN o_orderkey % 13 > 0 THEN (o_orderkey * 7 % 2001 - 1000) / 1000.0 END"


def _texts(s: SparkSession, d: str) -> DataFrame:
    """What a lag and a rank correlation are called, in the words of both studies; both numbers follow from the key of an order."""
    rows = demo.table(s, d, "orders").select("o_orderkey", F.expr(_LAG).alias("lag"), F.expr(_CORR).cast("double").alias("corr"))
    return rows.select("o_orderkey", C.lead_lag_text("lag", "corr").alias("lifecycle"), C.lead_lag_text("lag", "corr", **C.STRUCTURE_WORDS).alias("structure"))


def _said(leads: str, follows: str, weak: str) -> str:
    way = "CASE WHEN corr > 0 THEN 'positive' ELSE 'negative' END || '_historical_alignment'"
    return f"CASE WHEN corr IS NULL OR abs(corr) < 0.1 THEN '{weak}' WHEN lag > 0 THEN '{leads}_' || lag || 'w_' || {way} WHEN lag < 0 THEN '{follows}_' || (-lag) || 'w_' || {way} ELSE 'same_week_' || {way} END"


add(
    "interpretation_text", _texts,
    f"""WITH o AS (SELECT o_orderkey, {_LAG} AS lag, CAST({_CORR} AS DOUBLE) AS corr FROM orders)
SELECT o_orderkey, {_said('mm_feature_leads_gold', 'gold_or_later_mm_alignment', 'weak_or_no_clear_historical_relationship')} AS lifecycle, {_said(**C.STRUCTURE_WORDS)} AS structure FROM o""",
)

# --- sources of prices --------------------------------------------------------------

_LABELS = {0: "FRED series", 1: "yahoo GC=F", 2: " Yahoo gc feed ", 3: "vendor", 4: "", 5: None}


def _labelled(s: SparkSession, d: str) -> DataFrame:
    label = F.lit(None).cast("string")
    for k, text in _LABELS.items():
        label = F.when(F.dayofyear("date") % 6 == k, F.lit(text)).otherwise(label)
    return demo.prices(s, d).select(*KEY, "close", label.alias("source"))


_LABEL = " ".join(f"WHEN {k} THEN {'NULL' if t is None else repr(t)}" for k, t in _LABELS.items())
_CLASS = "CASE WHEN trim(coalesce(label, '')) = '' THEN 'Missing' WHEN contains(lower(label), 'fred') THEN 'FRED' WHEN contains(lower(label), 'yahoo') THEN 'Yahoo' WHEN contains(lower(label), 'stooq') THEN 'Stooq' ELSE 'Other' END"
_NO = "CAST(NULL AS VARCHAR)"
add(
    "source_audit_classes", lambda s, d: tidy(Q.source_audit(_labelled(s, d)), ["series_id", "section", "item", "label", "n", "first", "last"], ["value"]),
    f"""WITH {PRICES}, l AS (SELECT *, CASE dayofyear(date) % 6 {_LABEL} END AS label FROM prices), k AS MATERIALIZED (SELECT *, {_CLASS} AS class FROM l),
t AS (SELECT series_id, count(close) AS n, min(date) FILTER (close IS NOT NULL) AS first, max(date) FILTER (close IS NOT NULL) AS last, min(close) AS low, max(close) AS high, avg(close) AS mean FROM k GROUP BY ALL),
c AS (SELECT s.series_id, item, count(k.date) AS n, min(date) AS first, max(date) AS last FROM (SELECT DISTINCT series_id, unnest({list(Q.SOURCE_CLASSES)}) AS item FROM k) s LEFT JOIN k ON k.series_id = s.series_id AND k.class = item GROUP BY ALL),
z AS (SELECT series_id, 'stats' AS section, unnest(['n', 'min', 'max', 'mean']) AS item, {_NO} AS label, n, first, last, unnest([CAST(n AS DOUBLE), low, high, mean]) AS value FROM t
UNION ALL SELECT series_id, 'class', item, {_NO}, n, first, last, n FROM c UNION ALL SELECT series_id, 'label', class, label, count(*), min(date), max(date), count(*) FROM k GROUP BY series_id, class, label)
SELECT series_id, section, item, label, n, first, last, {r6('value')} AS value FROM z""",
)

# --- calendars ----------------------------------------------------------------------


def _calendar_file(s: SparkSession, d: str) -> str:
    """A calendar with all of its parts, whose dates follow from the bars: day k is k days after the first Monday of trading."""
    first = demo.bars(s, d, "day").agg(F.min(F.date_trunc("week", "date").cast("date")).alias("m"))
    day = lambda k: F.date_add("m", k).cast("string")
    holiday = lambda k, url, off, status=None, sure=None: F.struct(day(k).alias("date"), F.lit(None).cast("boolean").alias("daily_bar_expected"), F.lit(off).alias("exclude_daily"), F.lit(status).cast("string").alias("settlement_status"), F.lit(sure).cast("boolean").alias("normal_trading_confirmed"), F.lit(url).cast("string").alias("source_url"))
    week = F.struct(F.array(day(21), day(22)).alias("expected_daily_dates"), F.lit(46).alias("expected_hourly_bars"), F.lit(True).alias("holiday_affected"))
    doc = first.select(
        F.array(F.lit("general"), F.lit("shared")).alias("sources"), F.struct(F.lit("normal").alias("source_url")).alias("normal_session"), F.lit("override").alias("override_source_url"),
        F.array(holiday(0, "new year", True), holiday(2, "shared", False, "normal_schedule"), holiday(8, "eighth", False, None, True), holiday(9, None, False, "normal_schedule"), holiday(10, "closed", True, "normal_schedule"), holiday(13, "sunday", True)).alias("holidays"),
        F.create_map(day(21), week).alias("weekly_overrides"), F.create_map(day(15), day(16), day(5), day(7)).alias("trade_date_overrides"),
        F.struct(F.array(day(1), day(1), day(9)).alias("quarantined_ohlc_dates"), F.array(day(3)).alias("source_null_dates")).alias("historical_price_quality_evidence"),
    )
    path = scratch(s, "calendar")
    doc.coalesce(1).write.json(path)
    return path


def _evidence(s: SparkSession, d: str) -> DataFrame:
    dates, trade, _ = R.read_calendar_evidence(s, _calendar_file(s, d))
    return dates.select("date", "kind", F.lit(None).cast("date").alias("trade_date")).unionByName(trade.select(F.col("calendar_date").alias("date"), F.lit("trade_date").alias("kind"), "trade_date"))


_M = "(SELECT min(CAST(date_trunc('week', ts) AS DATE)) AS m FROM events)"
add("calendar_evidence", _evidence, f"SELECT m + k AS date, kind, m + t AS trade_date FROM {_M}, (VALUES (1, 'quarantined', NULL), (9, 'quarantined', NULL), (3, 'null_at_source', NULL), (2, 'confirmed', NULL), (8, 'confirmed', NULL), (15, 'trade_date', 16), (5, 'trade_date', 7)) AS v(k, kind, t)")


def _week_sources(s: SparkSession, d: str) -> DataFrame:
    path = _calendar_file(s, d)
    weeks = reports(s, d).select(C.next_week_start("report_date").alias("week_start")).withColumn("week_end", F.date_add("week_start", 4))
    _, trade, notices = R.read_calendar_evidence(s, path)
    found = R.week_sources(weeks, R.read_calendar(s, path)[1], trade, notices)
    return found.select("week_start", F.array_join("sources", ",").alias("sources"))


add(
    "calendar_week_sources", _week_sources,
    f"""WITH w AS (SELECT DISTINCT CAST(date_trunc('week', ts) AS DATE) AS week_start FROM events), k AS (SELECT week_start, (week_start - m) // 7 AS k FROM w, {_M}), n AS (SELECT week_start, k, unnest([1, 2, 3, 4, 5, 6, 7]) AS p, unnest(['general', 'shared', 'normal', 'override', 'new year', 'eighth', 'closed']) AS url FROM k)
SELECT week_start, string_agg(url, ',' ORDER BY p) AS sources FROM n WHERE p <= 3 OR (p = 4 AND k IN (2, 3)) OR (p = 5 AND k = 0) OR (p > 5 AND k = 1) GROUP BY ALL""",
)

# --- stored results -------------------------------------------------------------------


def _stored_cases(s: SparkSession, d: str) -> DataFrame:
    """The similar cases as they were stored, with faults: a case lost, a score and a return changed, one of an old date and one that the table lacks."""
    frame = stored(demo.weekly(s, d), "weekly-frame")
    now = frame.groupBy("series_id").agg(F.max("date").alias("current_date"))
    rows = cases(s, d, frame).join(now, "series_id").select("series_id", "rank", "date", "current_date", "score", *FWD.values())
    at = lambda series, rank: (F.col("series_id") == series) & (F.col("rank") == rank)
    rows = rows.filter(~at("ASIA", 3)).withColumns(
        {"score": F.col("score") + F.when(at("EUROPE", 5), 0.001).otherwise(0.0), "f4": F.col("f4") + F.when(at("AFRICA", 7), 1e-6).otherwise(0.0), "current_date": F.when(at("AMERICA", 2), F.date_sub("current_date", 7)).otherwise(F.col("current_date")), "date": F.when(at("MIDDLE EAST", 4), F.date_add("date", 1)).otherwise(F.col("date"))}
    )
    return Q.validate_cases(rows, frame, FEATURES, FWD)


_AT = "series_id = '{}' AND rank = {}"
add(
    "validate_cases", _stored_cases,
    f"""{CASES}, e AS (SELECT series_id, count(*) AS k, count(*) FILTER ({_AT.format('ASIA', 3)}) AS lost, count(*) FILTER ({_AT.format('EUROPE', 5)}) AS scored, count(*) FILTER ({_AT.format('AFRICA', 7)}) AS returned, count(*) FILTER ({_AT.format('AMERICA', 2)}) AS old, count(*) FILTER ({_AT.format('MIDDLE EAST', 4)}) AS odd FROM cases GROUP BY ALL)
SELECT s.series_id, coalesce(k - lost, 0) AS n, coalesce(old, 0) AS other_current, coalesce(odd, 0) AS unknown_date, coalesce(returned + odd, 0) AS bad_return, coalesce(scored + odd, 0) AS not_expected, coalesce(lost + scored + odd, 0) AS not_stored FROM (SELECT DISTINCT series_id FROM weekly) s LEFT JOIN e USING (series_id)""",
)
_SHARES = {"mm_percentile": "mm_pct", "producer_percentile": "producer_pct", "oi_percentile": "oi_pct"}


def _summaries(s: SparkSession, d: str) -> DataFrame:
    """Summary records of the last rows; that of one series is a week old, another's close is off by a tenth, a third one's share by a hundredth of a point, a fourth has none."""
    frame = stored(demo.weekly(s, d).select(*KEY, "close", *_SHARES.values()), "weekly-frame")
    one = frame.groupBy("series_id").agg(F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in ("close", *_SHARES.values())])
    of = lambda name, x: F.when(F.col("series_id") == name, x).otherwise(0)
    one = one.filter("series_id <> 'MIDDLE EAST'").select("series_id", F.date_sub("date", of("ASIA", 7)).alias("date"), (F.col("close") + of("EUROPE", 0.1)).alias("close"), *[(F.col(b) * 100 + of("AFRICA", 0.01)).alias(a) for a, b in _SHARES.items()])
    return Q.validate_summary(one, frame, _SHARES)


add("validate_summary", _summaries, f"{FULL} SELECT DISTINCT series_id, series_id NOT IN ('ASIA', 'MIDDLE EAST') AS same_date, series_id NOT IN ('EUROPE', 'MIDDLE EAST') AS same_close, series_id NOT IN ('AFRICA', 'MIDDLE EAST') AND bool_and(coalesce(p, false)) OVER (PARTITION BY series_id) AS same_shares FROM (SELECT series_id, mm_pct + producer_pct + oi_pct IS NOT NULL AS p FROM weekly QUALIFY date = max(date) OVER (PARTITION BY series_id))")


def _health(s: SparkSession, d: str) -> DataFrame:
    """Health records where the lifecycle of one series ends a week early, the cases of another are of an older date, and a third has none."""
    frame = stored(demo.weekly(s, d), "weekly-frame")
    found = cases(s, d, frame).join(frame.groupBy("series_id").agg(F.max("date").alias("current_date")), "series_id").filter("series_id <> 'AFRICA'")
    found = found.withColumn("current_date", F.when(F.col("series_id") == "EUROPE", F.date_sub("current_date", 7)).otherwise(F.col("current_date")))
    short = F.col("date") == F.max("date").over(M.Window.partitionBy("series_id"))
    life = frame.select(*KEY, short.alias("end")).filter("not (end and series_id = 'ASIA')")
    stats = M.top_groups(found, FWD).filter("size = 20")
    out = Q.data_health(frame, {"lifecycle": life, "weekly": frame}, found, stats, ["date", "close", "mm_net"])
    dates = F.array_join(F.transform(F.array_sort(F.map_entries("component_dates")), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(e["value"].cast("string"), F.lit("none")))), ",")
    return out.select("series_id", "status", "overall", F.array_join("warnings", ",").alias("warnings"), "expected", dates.alias("component_dates"), F.array_join("stale", ",").alias("stale"), "master_rows", "cases", "stats_rows", F.size("missing_columns").alias("n_missing_columns"))


add(
    "hub_health", _health,
    f"""{TOP}, e AS (SELECT series_id, max(date) AS expected, count(*) AS master_rows, max(date) FILTER (series_id <> 'ASIA' OR date < top) AS life FROM (SELECT *, max(date) OVER (PARTITION BY series_id) AS top FROM weekly) GROUP BY ALL),
c AS (SELECT series_id, count(*) AS cases FROM cases WHERE series_id <> 'AFRICA' GROUP BY ALL), h AS (SELECT e.*, coalesce(cases, 0) AS cases, CASE WHEN cases > 0 THEN 1 ELSE 0 END AS stats_rows, CASE WHEN cases > 0 THEN expected - CASE WHEN series_id = 'EUROPE' THEN 7 ELSE 0 END END AS case_date FROM e LEFT JOIN c USING (series_id)),
t AS (SELECT *, concat_ws(',', CASE WHEN coalesce(case_date <> expected, true) THEN 'cases' END, CASE WHEN life <> expected THEN 'lifecycle' END) AS stale FROM h)
SELECT series_id, CASE WHEN stale = '' THEN 'ok' ELSE 'partial_stale' END AS status, CASE WHEN stale = '' THEN 'OK' ELSE 'PARTIAL_STALE' END AS overall, concat_ws(',', CASE WHEN case_date <> expected THEN 'case_date_mismatch' END, CASE WHEN stale <> '' THEN 'stale_components' END, CASE WHEN cases = 0 THEN 'cases_empty' END, CASE WHEN stats_rows = 0 THEN 'case_stats_empty' END) AS warnings,
expected, 'cases:' || coalesce(CAST(case_date AS VARCHAR), 'none') || ',lifecycle:' || CAST(life AS VARCHAR) || ',weekly:' || CAST(expected AS VARCHAR) AS component_dates, stale, master_rows, cases, CAST(stats_rows AS BIGINT) AS stats_rows, 0 AS n_missing_columns FROM t""",
)
