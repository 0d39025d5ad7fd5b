"""Queries over the weekly frame: windows, scalars and states, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import windows as W
from . import demo, sql
from .sql import FULL, LIFE, STRUCT, frame, lag, r6

KEY = ("series_id", "date")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def rounded(df: DataFrame, cols: list[str], keys: tuple[str, ...] = KEY) -> DataFrame:
    return df.select(*keys, *[C.r6(c).alias(c) for c in cols])


def weekly_of(cols: list[str], text: list[str] | None = None):
    """The given columns of the weekly frame, and their SQL."""
    text = text or []
    run = lambda spark, sf: demo.weekly(spark, sf).select(*KEY, *[C.r6(c).alias(c) for c in cols], *text)
    return run, f"{FULL} SELECT series_id, date{''.join(f', {r6(c)} AS {c}' for c in cols)}{''.join(', ' + t for t in text)} FROM weekly"


add("trailing_returns", *weekly_of(["close", "r1", "r2", "r4", "r8"]))
add("forward_returns", *weekly_of(["close", "f1", "f2", "f4", "f8"]))
add("rolling_zscore", *weekly_of(["r1_z", "mm_z", "oi_z", "close_z"]))
add("rolling_percentile", *weekly_of(["mm_pct", "producer_pct", "swap_pct", "oi_pct", "close_pct"]))
add("price_regime", *weekly_of(["close"], ["regime"]))
add("sample_split", *weekly_of(["close"], ["split"]))
add("position_changes", lambda s, d: rounded(W.changes(demo.master(s, d), ["mm_net", "producer_net", "swap_net", "oi"]), ["mm_net_change", "producer_net_change", "swap_net_change", "oi_change"]),
    f"{sql.BASE} SELECT series_id, date, {', '.join(f'{r6(f'{c} - {lag(c, 1)}')} AS {c}_change' for c in ('mm_net', 'producer_net', 'swap_net', 'oi'))} FROM master")
add("prior_percentile", lambda s, d: rounded(demo.structure(s, d), ["long_pct", "short_pct", "net_pct"]), f"{STRUCT} SELECT series_id, date, {r6('long_pct')} AS long_pct, {r6('short_pct')} AS short_pct, {r6('net_pct')} AS net_pct FROM structure")
add("prior_zscore", lambda s, d: rounded(demo.definitions(s, d), ["mm_net__z52", "mm_net__z156"]), f"{sql.DEFS} SELECT series_id, date, {r6('mm_net__z52')} AS mm_net__z52, {r6('mm_net__z156')} AS mm_net__z156 FROM defs")
add("full_history_percentile", lambda s, d: rounded(demo.definitions(s, d), ["mm_net__full", "oi__full"]), f"{sql.DEFS} SELECT series_id, date, {r6('mm_net__full')} AS mm_net__full, {r6('oi__full')} AS oi__full FROM defs")
add("velocity_acceleration", lambda s, d: rounded(demo.lifecycle(s, d), ["mm_pct_v4", "mm_pct_v8", "mm_pct_v12", "mm_pct_v26", "mm_accel8"]),
    f"{LIFE} SELECT series_id, date, {', '.join(f'{r6(c)} AS {c}' for c in ('mm_pct_v4', 'mm_pct_v8', 'mm_pct_v12', 'mm_pct_v26', 'mm_accel8'))} FROM life")


def _drawdown(s: SparkSession, d: str) -> DataFrame:
    w = W.by_series()
    return rounded(demo.master(s, d).withColumns({f"dd{h}": W.forward_drawdown("close", h, w) for h in demo.HORIZONS}), [f"dd{h}" for h in demo.HORIZONS])


def _drawdown_sql(h: int) -> str:
    """For each later row of the window the fall from the highest row up to it."""
    a = frame("list(close)", "CURRENT ROW", f"{h} FOLLOWING")
    return f"CASE WHEN len({a}) = {h + 1} THEN list_min(list_transform(range(1, {h + 2}), lambda i: {a}[i] / list_max({a}[1:i]) - 1)) END"


add("forward_drawdown", _drawdown, f"{sql.BASE} SELECT series_id, date, {', '.join(f'{r6(_drawdown_sql(h))} AS dd{h}' for h in demo.HORIZONS)} FROM master")
add("normalized_index", lambda s, d: rounded(demo.master(s, d).withColumn("index", W.normalized_index("close", W.by_series())), ["index"]),
    f"{sql.BASE} SELECT series_id, date, {r6('close / first_value(close) OVER (PARTITION BY series_id ORDER BY date) * 100')} AS index FROM master")


def weekly_changes(s: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    """One-week changes of long, short and net, their shares of the week before, and states."""
    w = W.by_series()
    df = demo.master(s, d) if base is None else base
    for c in ("mm_long", "mm_short", "mm_net"):
        before = F.lag(c, 1).over(w)
        df = df.withColumns({f"{c}_change": F.col(c) - before, f"{c}_change_pct": C.ratio(F.col(c) - before, F.abs(before))})
    return df.withColumn("state", C.weekly_change_state("mm_long_change", "mm_short_change", "mm_net_change"))


_CHANGES = [f"{c}_change{p}" for c in ("mm_long", "mm_short", "mm_net") for p in ("", "_pct")]
_CH_SQL = "ch AS MATERIALIZED (SELECT series_id, date, " + ", ".join(f"{c} - {lag(c, 1)} AS {c}_change, ({c} - {lag(c, 1)}) / nullif(abs({lag(c, 1)}), 0) AS {c}_change_pct" for c in ("mm_long", "mm_short", "mm_net")) + " FROM master)"
_STATE_SQL = """CASE WHEN mm_long_change > 0 AND mm_short_change < 0 THEN 'LONG_BUILDING_SHORT_COVERING' WHEN mm_long_change > 0 AND mm_short_change > 0 THEN 'LONG_BUILDING_SHORT_BUILDING'
 WHEN mm_long_change < 0 AND mm_short_change < 0 THEN 'LONG_LIQUIDATION_SHORT_COVERING' WHEN mm_long_change < 0 AND mm_short_change > 0 THEN 'LONG_LIQUIDATION_SHORT_BUILDING'
 WHEN mm_net_change > 0 THEN 'NET_UP' WHEN mm_net_change < 0 THEN 'NET_DOWN' ELSE 'NEUTRAL' END"""
CHANGES_SQL = f"{sql.BASE},\n{_CH_SQL}"
add("weekly_changes", lambda s, d: rounded(weekly_changes(s, d), _CHANGES), f"{CHANGES_SQL} SELECT series_id, date, {', '.join(f'{r6(c)} AS {c}' for c in _CHANGES)} FROM ch")
add("weekly_change_state", lambda s, d: weekly_changes(s, d).select(*KEY, "state"), f"{CHANGES_SQL} SELECT series_id, date, {_STATE_SQL} AS state FROM ch")
add("net_reconciliation", lambda s, d: demo.structure(s, d).select(*KEY, C.r6("net_change8").alias("net_change8"), C.r6(F.col("net_change8") - (F.col("long_change8") - F.col("short_change8"))).alias("error")),
    f"{STRUCT} SELECT series_id, date, {r6('net_change8')} AS net_change8, {r6('net_change8 - (long_change8 - short_change8)')} AS error FROM structure")
add("rank_decile", lambda s, d: W.rank_decile_rows(demo.weekly(s, d), "mm_z", ["series_id"], ["date"], "bucket").select(*KEY, "bucket"),
    f"""{FULL} SELECT series_id, date, CAST(CASE WHEN mm_z IS NOT NULL AND min(mm_z) OVER (PARTITION BY series_id) < max(mm_z) OVER (PARTITION BY series_id) THEN
greatest(0, ((row_number() OVER (PARTITION BY series_id, mm_z IS NULL ORDER BY mm_z, date) - 1) * 10 + count(mm_z) OVER (PARTITION BY series_id) - 2) // greatest(count(mm_z) OVER (PARTITION BY series_id) - 1, 1) - 1) + 1 END AS INTEGER) AS bucket FROM weekly""")  # fmt: skip
add("average_rank", lambda s, d: demo.weekly(s, d).filter("mm_pct is not null").select(*KEY, W.average_rank("mm_pct", ["series_id"]).alias("up"), W.average_rank("mm_pct", ["series_id"], True).alias("down"), C.r6(W.percent_rank_average("mm_pct", ["series_id"])).alias("share")),
    f"""{FULL}, x AS (SELECT * FROM weekly WHERE mm_pct IS NOT NULL) SELECT series_id, date, CAST(rank() OVER (PARTITION BY series_id ORDER BY mm_pct) + (count(*) OVER (PARTITION BY series_id, mm_pct) - 1) / 2.0 AS DOUBLE) AS up,
CAST(rank() OVER (PARTITION BY series_id ORDER BY mm_pct DESC) + (count(*) OVER (PARTITION BY series_id, mm_pct) - 1) / 2.0 AS DOUBLE) AS down, {r6(sql.full_rank('mm_pct', 'series_id'))} AS share FROM x""")  # fmt: skip


def _paths(s: SparkSession, d: str) -> DataFrame:
    p = W.paths(demo.weekly(s, d), "mm_pct", 8)
    return p.select(*KEY, "start_date", F.size("path").alias("n"), C.r6(F.element_at("path", 1)).alias("first"), C.r6(F.aggregate("path", F.lit(0.0), lambda a, x: a + x)).alias("total"))


_PATH_SQL = f"x AS (SELECT * FROM weekly WHERE mm_pct IS NOT NULL), p AS (SELECT series_id, date, {frame('list(mm_pct)', '8 PRECEDING', 'CURRENT ROW')} AS path, {frame('min(date)', '8 PRECEDING', 'CURRENT ROW')} AS start_date FROM x)"
add("series_paths", _paths, f"{FULL}, {_PATH_SQL} SELECT series_id, date, start_date, CAST(len(path) AS INTEGER) AS n, {r6('path[1]')} AS first, {r6('list_sum(path)')} AS total FROM p WHERE len(path) = 9")
add("path_json", lambda s, d: W.paths(demo.weekly(s, d), "mm_pct", 4).select(*KEY, F.size("path").alias("n"), F.size(F.from_json(C.path_json("path"), "array<double>")).alias("n_json"), C.r6(F.element_at(F.from_json(C.path_json("path"), "array<double>"), -1)).alias("last")),
    f"{FULL}, x AS (SELECT * FROM weekly WHERE mm_pct IS NOT NULL), p AS (SELECT series_id, date, {frame('list(mm_pct)', '4 PRECEDING', 'CURRENT ROW')} AS path FROM x) SELECT series_id, date, 5 AS n, 5 AS n_json, {r6('round(path[5] * 100, 4)')} AS last FROM p WHERE len(path) = 5")
add("lifecycle_state", lambda s, d: demo.lifecycle(s, d).select(*KEY, "lifecycle_state"), f"{LIFE} SELECT series_id, date, lifecycle_state FROM life")
add("contribution_state", lambda s, d: demo.structure(s, d).select(*KEY, "contribution_state"), f"{STRUCT} SELECT series_id, date, contribution_state FROM structure")
add("structure_state", lambda s, d: demo.structure(s, d).select(*KEY, "structure_state"), f"{STRUCT} SELECT series_id, date, structure_state FROM structure")


_READ = ["long_delta", "fast", "long_alignment", "short_alignment", "net_alignment", "reading"]


def with_readings(df: DataFrame) -> DataFrame:
    """df (with the columns of demo.structure) and the readings of its velocities."""
    two, four = F.col("short_pct_v2"), F.col("short_pct_v4")
    df = df.withColumn("fast", F.coalesce((two + four) / 2, two, four))
    return df.withColumns(
        {"long_delta": F.col("long_pct_v8") - F.col("long_pct_v26"), "long_alignment": C.alignment("long_pct_v8", "long_pct_v26"), "short_alignment": C.alignment("short_pct_v8", "fast"), "net_alignment": C.alignment("net_pct_v8", "net_pct_v26"),
         "reading": C.velocity_reading("long_pct_v8", "long_pct_v26", "fast", "net_pct_v8", "net_pct_v26")}
    )


def velocity_readings(s: SparkSession, d: str, base: DataFrame | None = None) -> DataFrame:
    df = with_readings(demo.structure(s, d, base))
    return df.select(*KEY, "structure_state", *[C.r6(c).alias(c) if c in ("long_delta", "fast") else c for c in _READ])


def _align_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'MIXED_OR_UNCLEAR' WHEN abs({a}) < 0.03 AND abs({b}) < 0.03 THEN 'BOTH_NEAR_ZERO' WHEN {a} > 0 AND {b} > 0 THEN 'SAME_DIRECTION_POSITIVE' WHEN {a} < 0 AND {b} < 0 THEN 'SAME_DIRECTION_NEGATIVE' WHEN {a} > 0 AND {b} < 0 THEN 'BASELINE_POSITIVE_CANDIDATE_NEGATIVE' WHEN {a} < 0 AND {b} > 0 THEN 'BASELINE_NEGATIVE_CANDIDATE_POSITIVE' ELSE 'MIXED_OR_UNCLEAR' END"


READING_SQL = f"""{STRUCT}, v AS MATERIALIZED (SELECT *, coalesce((short_pct_v2 + short_pct_v4) / 2, short_pct_v2, short_pct_v4) AS fast FROM structure),
rd AS MATERIALIZED (SELECT series_id, date, structure_state, {r6('long_pct_v8 - long_pct_v26')} AS long_delta, {r6('fast')} AS fast, {_align_sql('long_pct_v8', 'long_pct_v26')} AS long_alignment, {_align_sql('short_pct_v8', 'fast')} AS short_alignment, {_align_sql('net_pct_v8', 'net_pct_v26')} AS net_alignment,
CASE WHEN long_pct_v8 IS NULL OR long_pct_v26 IS NULL OR fast IS NULL OR net_pct_v8 IS NULL OR net_pct_v26 IS NULL THEN 'MIXED_STRUCTURE' WHEN long_pct_v26 > 0 AND net_pct_v26 > 0 THEN 'MEDIUM_TERM_PARTICIPATION_BUILDING'
WHEN long_pct_v26 < 0 AND net_pct_v26 < 0 THEN 'MEDIUM_TERM_STRUCTURE_WEAKENING' WHEN abs(fast) >= 0.03 AND abs(long_pct_v26) < 0.03 AND abs(net_pct_v26) < 0.03 THEN 'SHORT_TERM_ONLY_REACTION'
WHEN (long_pct_v8 > 0 OR net_pct_v8 > 0) AND (long_pct_v26 <= 0 OR net_pct_v26 <= 0) THEN 'SHORT_TERM_RECOVERY_MEDIUM_TERM_UNCONFIRMED' ELSE 'MIXED_STRUCTURE' END AS reading FROM v)"""
add("velocity_reading", velocity_readings, f"{READING_SQL} SELECT * FROM rd")
add("percentile_state", lambda s, d: demo.weekly(s, d).select(*KEY, C.percentile_state("mm_pct").alias("state"), C.percentile_level("mm_pct").alias("level")),
    f"""{FULL} SELECT series_id, date, CASE WHEN mm_pct IS NULL THEN 'N/A' WHEN mm_pct * 100 < 20 THEN 'MM_EXTREME_LOW' WHEN mm_pct * 100 < 40 THEN 'MM_LOW' WHEN mm_pct * 100 < 60 THEN 'MM_NEUTRAL' WHEN mm_pct * 100 < 80 THEN 'MM_HIGH' ELSE 'MM_EXTREME_HIGH' END AS state,
CASE WHEN mm_pct IS NULL THEN 'N/A' WHEN mm_pct * 100 < 10 THEN '極低' WHEN mm_pct * 100 < 20 THEN '偏低到極低' WHEN mm_pct * 100 < 40 THEN '偏低' WHEN mm_pct * 100 < 60 THEN '中性' WHEN mm_pct * 100 < 80 THEN '偏高' WHEN mm_pct * 100 < 90 THEN '高' ELSE '極高' END AS level FROM weekly""")  # fmt: skip
_MS = "CASE WHEN {m} IS NULL THEN 'N/A' WHEN {m} >= 80 AND {o} >= 60 THEN 'Expansion / Momentum' WHEN {m} >= 80 THEN 'Euphoria / Thin Momentum' WHEN {m} >= 60 THEN '{h}' WHEN {m} >= 40 THEN 'Neutral / Transition' WHEN {m} >= 20 THEN 'Accumulation / Weak Positioning' ELSE 'Extreme Low / Potential Reset' END"
add("market_state", lambda s, d: demo.weekly(s, d).select(*KEY, C.market_state("mm_pct", "oi_pct").alias("state"), C.market_state(F.col("mm_pct") * 100, F.col("oi_pct") * 100, strict=True).alias("strict_state")),
    f"{FULL} SELECT series_id, date, {_MS.format(m='(mm_pct * 100)', o='(oi_pct * 100)', h='Healthy High Positioning')} AS state, {_MS.format(m='(mm_pct * 100)', o='(oi_pct * 100)', h='Healthy Bullish Positioning')} AS strict_state FROM weekly")
add("anomaly_reason", lambda s, d: demo.weekly(s, d).select(*KEY, C.anomaly_reason("date", "close", "r1", "r1_z", "close_z", 1997, (200000, 300000)).alias("reason")).withColumn("flag", F.col("reason") != ""),
    f"""{FULL}, x AS (SELECT series_id, date, CASE WHEN year(date) >= 1997 THEN concat_ws('; ', CASE WHEN close >= 200000 THEN 'level>=200000' END, CASE WHEN close >= 300000 THEN 'level>=300000' END, CASE WHEN abs(r1) >= 0.05 THEN 'abs_1w_return>=5pct' END,
CASE WHEN abs(r1_z) >= 2.5 THEN 'abs_return_zscore_52w>=2.5' END, CASE WHEN close_z >= 2.5 THEN 'level_zscore_156w>=2.5' END) ELSE '' END AS reason FROM weekly) SELECT *, reason <> '' AS flag FROM x""")  # fmt: skip
_EDGES = " ".join(f"WHEN x <= {k / 10} THEN {k}" for k in range(1, 10))
add("bucketizers", lambda s, d: demo.lifecycle(s, d).select(*KEY, C.decile_closed_right("mm_pct").alias("closed"), C.decile_floor("mm_pct").alias("floored"), C.velocity_bucket("mm_pct_v8").alias("velocity")),
    f"""{LIFE}, y AS (SELECT *, least(greatest(mm_pct, 0.0), 1.0) AS x, mm_pct_v8 * 100 AS v FROM life) SELECT series_id, date, CASE WHEN mm_pct IS NULL THEN NULL {_EDGES} ELSE 10 END AS closed, CASE WHEN mm_pct IS NOT NULL THEN CAST(least(floor(mm_pct * 10), 9) AS INTEGER) + 1 END AS floored,
CASE WHEN v IS NULL THEN NULL WHEN v < -30 THEN 1 WHEN v < -10 THEN 2 WHEN v < 0 THEN 3 WHEN v < 10 THEN 4 WHEN v < 30 THEN 5 ELSE 6 END AS velocity FROM y""")  # fmt: skip
add("calendar_helpers", lambda s, d: demo.positions(s, d).select(*KEY, C.next_week_start("date").alias("monday"), F.date_add(C.next_week_start("date"), 4).alias("friday"), C.months_before("date", 12).alias("year_before"), F.date_sub(C.months_before("date", 12), 7).alias("scope_start"),
        F.greatest(F.date_sub("date", 729), F.date_sub(F.date_trunc("week", F.date_add(C.months_before("date", 24), 1)).cast("date"), 1)).alias("sunday")),
    f"""WITH {sql.POSITIONS} SELECT series_id, date, CAST(date_trunc('week', date) AS DATE) + 7 AS monday, CAST(date_trunc('week', date) AS DATE) + 11 AS friday, CAST(date - INTERVAL 12 MONTH AS DATE) AS year_before, CAST(date - INTERVAL 12 MONTH AS DATE) - 7 AS scope_start,
greatest(date - 729, CAST(date_trunc('week', CAST(date - INTERVAL 24 MONTH AS DATE) + 1) AS DATE) - 1) AS sunday FROM positions""")  # fmt: skip
add("percent_points", lambda s, d: demo.weekly(s, d).select(*KEY, C.r6(C.points("mm_pct")).alias("unit"), C.r6(C.points("r8", "abs")).alias("absolute"), C.r6(C.points("mm_z")).alias("mixed")),
    f"{FULL} SELECT series_id, date, {r6('mm_pct * 100')} AS unit, {r6('CASE WHEN abs(r8) <= 1 THEN r8 * 100 ELSE r8 END')} AS absolute, {r6('CASE WHEN mm_z BETWEEN 0 AND 1 THEN mm_z * 100 ELSE mm_z END')} AS mixed FROM weekly")
add("net_positions", lambda s, d: rounded(demo.net(demo.positions(s, d)), ["mm_net", "producer_net", "swap_net", "oi"]), f"WITH {sql.POSITIONS} SELECT series_id, date, {', '.join(f'{r6(f'{k}_long - {k}_short')} AS {k}_net' for k in ('mm', 'producer', 'swap'))}, {r6('oi')} AS oi FROM positions")
add("study_window_filter", lambda s, d: rounded(demo.positions(s, d).filter((F.col("date") >= "1996-01-01") & (F.year("date") <= 2000)), ["oi"]), f"WITH {sql.POSITIONS} SELECT series_id, date, {r6('oi')} AS oi FROM positions WHERE date >= DATE '1996-01-01' AND year(date) <= 2000")
add("history_filter", lambda s, d: demo.lifecycle(s, d).filter(F.col("date").between("1997-01-01", "2000-12-31") & F.col("mm_pct").between(0.2, 0.9) & F.col("lifecycle_state").isin("MM_EXPANSION", "MM_DISTRIBUTION") & F.col("date").cast("string").contains("-1")).select(*KEY, C.r6("mm_pct").alias("mm_pct"), "lifecycle_state"),
    f"{LIFE} SELECT series_id, date, {r6('mm_pct')} AS mm_pct, lifecycle_state FROM life WHERE date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' AND mm_pct BETWEEN 0.2 AND 0.9 AND lifecycle_state IN ('MM_EXPANSION', 'MM_DISTRIBUTION') AND contains(CAST(date AS VARCHAR), '-1')")
add("long_window_percentile", lambda s, d: rounded(W.long_window_percentile(demo.master(s, d).select("series_id", "date", "mm_net"), "mm_net", {"p260": 260, "p156": 156}, 52), ["p260", "p156"]),
    f"{sql.BASE} SELECT series_id, date, {r6(sql.prior_percentile('mm_net', 260, 52))} AS p260, {r6(sql.prior_percentile('mm_net', 156, 52))} AS p156 FROM master")
