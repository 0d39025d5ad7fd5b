"""Queries of similar states, paths and events, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins as J
from ..operators import similarity as M
from ..operators import windows as W
from ..sources.paths import stored
from . import demo
from .sql import FULL, LIFE, frame, r6
from .studies import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FEATURES = ["mm_pct", "producer_pct", "oi_pct"]
FWD = {h: f"f{h}" for h in demo.HORIZONS}
P = "PARTITION BY series_id"


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def cases(s: SparkSession, d: str, frame: DataFrame | None = None) -> DataFrame:
    return M.similar_states(demo.weekly(s, d) if frame is None else frame, FEATURES, keep=list(FWD.values()))


_FULLROW = " AND ".join(f"{f} IS NOT NULL" for f in FEATURES)
_DIST = " + ".join(f"abs({f} - last_value({f}) OVER ({P} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) * 100" for f in FEATURES)
_CAND = f"""{FULL}, a AS (SELECT *, row_number() OVER ({P} ORDER BY date) AS pos FROM weekly), b AS MATERIALIZED (SELECT *, {_DIST} AS distance, max(pos) OVER ({P}) AS last FROM a WHERE {_FULLROW}),
cand AS MATERIALIZED (SELECT *, 100 - least(greatest(distance / 300 * 100, 0), 100) AS score FROM b WHERE pos < last + 1 - 52)"""
CASES = f"{_CAND}, cases AS MATERIALIZED (SELECT *, row_number() OVER ({P} ORDER BY floor(score * 1e10 + 0.5) DESC, date) AS rank FROM cand QUALIFY rank <= 20)"
add("similar_states", lambda s, d: tidy(cases(s, d), ["series_id", "rank", "date"], ["score", "distance", "mm_pct", "f8"]), f"{CASES} SELECT series_id, CAST(rank AS INTEGER) AS rank, date, {r6('score')} AS score, {r6('distance')} AS distance, {r6('mm_pct')} AS mm_pct, {r6('f8')} AS f8 FROM cases")


def _vector(s: SparkSession, d: str) -> DataFrame:
    """Of each feature the current value, and mean and deviation (1 if none) of the candidates."""
    c = M.similar_states(demo.weekly(s, d), FEATURES, top=None)
    long = c.select("series_id", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in FEATURES])).alias("k")).select("series_id", "k.*")
    stat = long.groupBy("series_id", "feature").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    full = demo.weekly(s, d).dropna(subset=FEATURES)
    now = full.groupBy("series_id").agg(F.max_by(F.array(*FEATURES), "date").alias("v"))
    now = now.select("series_id", F.explode(F.arrays_zip(F.array(*[F.lit(f) for f in FEATURES]).alias("feature"), F.col("v").alias("current"))).alias("k")).select("series_id", "k.*")
    return tidy(now.join(stat, ["series_id", "feature"]).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)), ["series_id", "feature"], ["current", "mean", "sd"])


add("feature_vector", _vector, f"{_CAND} " + " UNION ALL ".join(f"SELECT c.series_id, '{f}' AS feature, {r6('any_value(n.v)')} AS current, {r6(f'avg({f})')} AS mean, {r6(f'CASE WHEN stddev_samp({f}) > 0 THEN stddev_samp({f}) ELSE 1 END')} AS sd FROM cand c JOIN (SELECT series_id, arg_max({f}, date) AS v FROM b GROUP BY ALL) n USING (series_id) GROUP BY c.series_id" for f in FEATURES))
add("nearest_percentile", lambda s, d: tidy(M.nearest_values(demo.weekly(s, d), "mm_pct"), ["series_id", "rank", "date"], ["mm_pct", "distance"]),
    f"""{FULL}, a AS (SELECT *, row_number() OVER ({P} ORDER BY date) AS pos, count(*) OVER ({P}) AS n, last_value(mm_pct) OVER ({P} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM weekly),
b AS (SELECT series_id, date, mm_pct, round(abs(mm_pct - now), 10) AS distance FROM a WHERE mm_pct IS NOT NULL AND now IS NOT NULL AND pos <= n - 8) SELECT series_id, CAST(row_number() OVER ({P} ORDER BY distance, date) AS INTEGER) AS rank, date, {r6('mm_pct')} AS mm_pct, {r6('distance')} AS distance FROM b QUALIFY rank <= 10""")  # fmt: skip
_G = ["avg1", "median1", "win1", "avg4", "median4", "win4", "avg8", "median8", "win8", "best", "worst"]


def _agg(h: int) -> str:
    return f"avg(f{h}) AS avg{h}, median(f{h}) AS median{h}, avg(CAST(f{h} > 0 AS INTEGER)) AS win{h}"


TOP = f"{CASES}, topg AS MATERIALIZED (SELECT series_id, size, count(*) AS cases, {', '.join(_agg(h) for h in demo.HORIZONS)}, max(f8) AS best, min(f8) AS worst FROM cases, (SELECT unnest([5, 10, 20]) AS size) WHERE rank <= size GROUP BY ALL)"
add("topk_group_stats", lambda s, d: tidy(M.top_groups(cases(s, d), FWD), ["series_id", "size"], _G, ["cases"]), f"{TOP} SELECT series_id, size, {', '.join(f'{r6(c)} AS {c}' for c in _G)}, cases FROM topg")


def _similarity_summary(s: SparkSession, d: str) -> DataFrame:
    long = cases(s, d).select("series_id", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("y")) for h, c in FWD.items()])).alias("k")).select("series_id", "k.*")
    q = lambda p: F.percentile("y", p)
    out = long.groupBy("series_id", "horizon").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.avg((F.col("y") > 0).cast("double")).alias("win"), F.min("y").alias("low"), F.max("y").alias("high"))
    return tidy(out, ["series_id", "horizon"], ["mean", "q1", "median", "q3", "win", "low", "high"], ["n"])


add("similarity_summary", _similarity_summary, f"{CASES} " + " UNION ALL ".join(f"SELECT series_id, {h} AS horizon, {r6(f'avg(f{h})')} AS mean, {r6(f'quantile_cont(f{h}, 0.25)')} AS q1, {r6(f'median(f{h})')} AS median, {r6(f'quantile_cont(f{h}, 0.75)')} AS q3, {r6(f'avg(CAST(f{h} > 0 AS INTEGER))')} AS win, {r6(f'min(f{h})')} AS low, {r6(f'max(f{h})')} AS high, count(f{h}) AS n FROM cases GROUP BY ALL" for h in demo.HORIZONS))


def tendencies(s: SparkSession, d: str, frame: DataFrame | None = None) -> DataFrame:
    c = cases(s, d, frame)
    t = M.top_groups(c, FWD).filter("size = 20").join(c.groupBy("series_id").agg(F.avg("score").alias("score")), "series_id")
    return t.select("series_id", "cases", C.tendency("avg1", "avg2", "avg4", "avg8", "win8").alias("tendency"), C.sample_tendency("median8", "win8").alias("sample_tendency"), C.confidence("cases", "win8", "median8", "avg8", "score").alias("confidence"), C.r6("score").alias("score"), C.r6("avg8").alias("avg8"), C.r6("win8").alias("win8"))


TEND = f"""{TOP}, tend AS MATERIALIZED (SELECT series_id, CASE WHEN avg1 IS NULL OR avg2 IS NULL OR avg4 IS NULL OR avg8 IS NULL THEN 'na' WHEN avg1 < 0 AND avg4 < 0 AND avg8 < 0 AND win8 < 0.45 THEN 'risk_off_caution' WHEN avg1 > 0 AND avg4 > 0 AND avg8 > 0 AND win8 >= 0.55 THEN 'tailwind' ELSE 'mixed' END AS tendency,
CASE WHEN median8 > 0 AND win8 >= 0.55 THEN 'historical_sample_positive' WHEN median8 < 0 AND win8 <= 0.45 THEN 'historical_sample_negative' ELSE 'historical_sample_mixed' END AS sample_tendency,
CASE WHEN cases >= 20 AND median8 * avg8 > 0 AND (win8 >= 0.75 OR win8 <= 0.25) AND sc >= 85 THEN 'High' WHEN cases >= 20 AND median8 * avg8 > 0 AND (win8 >= 0.65 OR win8 <= 0.35) THEN 'Medium' ELSE 'Low' END AS confidence, {r6('sc')} AS score, {r6('avg8')} AS avg8, {r6('win8')} AS win8
FROM topg JOIN (SELECT series_id, avg(score) AS sc FROM cases GROUP BY ALL) USING (series_id) WHERE size = 20)"""
add("tendency_confidence", lambda s, d: tendencies(s, d).drop("cases"), f"{TEND} SELECT * FROM tend")


def _best_worst(s: SparkSession, d: str) -> DataFrame:
    rows = cases(s, d).withColumn("size", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20)))).filter("rank <= size and f8 is not null")
    best, worst = F.min(F.struct((-F.col("f8")).alias("v"), "date")), F.min(F.struct(F.col("f8").alias("v"), "date"))
    out = rows.groupBy("series_id", "size").agg(best.alias("b"), worst.alias("w"))
    return out.select("series_id", "size", F.col("b.date").alias("best_date"), C.r6(-F.col("b.v")).alias("best"), F.col("w.date").alias("worst_date"), C.r6("w.v").alias("worst"))


add("best_worst_cases", _best_worst, f"{CASES} SELECT series_id, size, arg_min(date, (-f8, date)) AS best_date, {r6('max(f8)')} AS best, arg_min(date, (f8, date)) AS worst_date, {r6('min(f8)')} AS worst FROM cases, (SELECT unnest([5, 10, 20]) AS size) WHERE rank <= size AND f8 IS NOT NULL GROUP BY ALL")


def similar_paths(s: SparkSession, d: str, vectorised: bool = False) -> DataFrame:
    w = stored(demo.weekly(s, d).select("series_id", "date", "mm_pct", "r8"), "weekly-frame")  # four path lengths and the returns read it
    return M.similar_paths(w, "mm_pct", vectorised=vectorised).join(w.select("series_id", "date", "r8"), ["series_id", "date"])


def _paths_sql() -> str:
    parts = []
    for n in (4, 8, 12, 26):
        p = frame("list(mm_pct)", f"{n} PRECEDING", "CURRENT ROW")
        parts.append(f"""SELECT series_id, date, r8, {n} AS weeks, path, arg_max(path, date) OVER ({P}) AS cur, max(date) OVER ({P}) AS last FROM (SELECT series_id, date, r8, {p} AS path FROM x) WHERE len(path) = {n + 1}""")
    off = lambda p: f"list_transform({p}, lambda v: v - list_avg({p}))"
    dot = lambda a, b: f"list_dot_product({off(a)}, {off(b)})"
    return f"""{FULL}, x AS (SELECT * FROM weekly WHERE mm_pct IS NOT NULL), pa AS MATERIALIZED ({' UNION ALL '.join(parts)}), pb AS (SELECT *, sqrt(list_sum(list_transform(list_zip(path, cur), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(path)) AS rmse, {dot('path', 'path')} AS va, {dot('cur', 'cur')} AS vb, {dot('path', 'cur')} AS vab FROM pa WHERE date <= last - 364),
pc AS (SELECT *, greatest(0, least(100, 100 * (1 - least(2, rmse + CASE WHEN va < 1e-18 OR vb < 1e-18 THEN 0.5 ELSE (1 - vab / sqrt(va * vb)) / 2 END) / 2))) AS score FROM pb), sp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id, weeks ORDER BY round(score, 9) DESC, date) AS rank FROM pc QUALIFY rank <= 20)"""


PATHS = _paths_sql()
_PK = ["series_id", "weeks", "rank", "date"]
_PSEL = f"{PATHS} SELECT series_id, weeks, CAST(rank AS INTEGER) AS rank, date, {r6('score')} AS score, {r6('r8')} AS r8 FROM sp"
add("trajectory_similarity", lambda s, d: tidy(similar_paths(s, d), _PK, ["score", "r8"]), _PSEL)
add("trajectory_similarity_vectorised", lambda s, d: tidy(similar_paths(s, d, True), _PK, ["score", "r8"]), _PSEL)
add("trajectory_outcomes", lambda s, d: tidy(similar_paths(s, d).groupBy("series_id", "weeks").agg(F.count("*").alias("n"), F.avg("r8").alias("avg"), F.median("r8").alias("median"), F.avg((F.col("r8") > 0).cast("double")).alias("win")), ["series_id", "weeks"], ["avg", "median", "win"], ["n"]),
    f"{PATHS} SELECT series_id, weeks, {r6('avg(r8)')} AS avg, {r6('median(r8)')} AS median, {r6('avg(CAST(r8 > 0 AS INTEGER))')} AS win, count(*) AS n FROM sp GROUP BY ALL")
add("similar_states_across", lambda s, d: tidy(M.similar_states_across(demo.weekly(s, d), FEATURES, top=10), ["query", "found", "date", "rank"], ["distance"]),
    f"""{FULL}, b AS MATERIALIZED (SELECT * FROM weekly WHERE {_FULLROW}), q AS (SELECT series_id AS query, {', '.join(f'arg_max({f}, date) AS q_{f}' for f in FEATURES)} FROM b GROUP BY ALL),
c AS (SELECT query, series_id AS found, date, ({' + '.join(f'abs({f} - q_{f})' for f in FEATURES)}) * 100 AS distance FROM q JOIN b ON query <> series_id) SELECT query, found, date, CAST(row_number() OVER (PARTITION BY query ORDER BY floor((100 - least(distance / 3, 100)) * 1e10 + 0.5) DESC, date, found) AS INTEGER) AS rank, {r6('distance')} AS distance FROM c QUALIFY rank <= 10""")  # fmt: skip
_LM = f"SELECT series_id, date, r1 FROM weekly WHERE abs(r1) >= 0.05"
add("largest_moves", lambda s, d: tidy(demo.weekly(s, d).filter("abs(r1) >= 0.05").withColumn("rank", F.row_number().over(W.Window.partitionBy("series_id").orderBy(F.desc(F.abs("r1")), "date"))).filter("rank <= 8"), ["series_id", "rank", "date"], ["r1"]),
    f"{FULL} SELECT series_id, CAST(row_number() OVER ({P} ORDER BY abs(r1) DESC, date) AS INTEGER) AS rank, date, {r6('r1')} AS r1 FROM ({_LM}) QUALIFY rank <= 8")
add("recent_rows", lambda s, d: tidy(demo.weekly(s, d).withColumn("k", F.row_number().over(W.Window.partitionBy("series_id").orderBy(F.desc("date")))).filter("k <= 100"), ["series_id", "date", "k"], ["close", "mm_pct"]),
    f"{FULL} SELECT series_id, date, CAST(row_number() OVER ({P} ORDER BY date DESC) AS INTEGER) AS k, {r6('close')} AS close, {r6('mm_pct')} AS mm_pct FROM weekly QUALIFY k <= 100")

# --- events -------------------------------------------------------------------

#: Bands of the percentile, lower bound in, upper bound out (the outer ones in).
BANDS = {"MM >= 80": "mm_pct >= 0.8", "MM <= 20": "mm_pct <= 0.2", "MM 60-80": "mm_pct >= 0.6 and mm_pct < 0.8", "MM 40-60": "mm_pct >= 0.4 and mm_pct < 0.6"}


def events(s: SparkSession, d: str) -> DataFrame:
    """One row for each date and band that it meets."""
    bands = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in BANDS.items()]))
    return demo.weekly(s, d).withColumn("band", F.explode(bands)).withColumn("series_band", F.concat_ws("|", "series_id", "band"))


_EV = f"{FULL}, ev AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT *, '{n}' AS band FROM weekly WHERE {c}" for n, c in BANDS.items()) + ")"
_KEPT = f"""{_EV}, evn AS (SELECT series_id, band, date, row_number() OVER (PARTITION BY series_id, band ORDER BY date) AS i FROM ev),
kept AS MATERIALIZED (SELECT series_id, band, unnest(list_reduce(list_transform(list(date ORDER BY date), lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 56 THEN list_append(a, x[1]) ELSE a END)) AS date FROM ev GROUP BY series_id, band)"""
add("event_condition", lambda s, d: tidy(events(s, d), ["series_id", "date", "band"], ["mm_pct"]), f"{_EV} SELECT series_id, date, band, {r6('mm_pct')} AS mm_pct FROM ev")
add("dedupe_events", lambda s, d: M.spaced_events(events(s, d), 56, ("series_id", "band")), f"{_KEPT} SELECT series_id, band, date FROM kept")


def _event_windows(s: SparkSession, d: str) -> DataFrame:
    w = demo.weekly(s, d)
    return J.event_window(w, w.filter("mm_pct >= 0.95"), "close")


_EWS = f"""{FULL}, a AS MATERIALIZED (SELECT series_id, date, close, mm_pct, row_number() OVER ({P} ORDER BY date) AS pos FROM weekly), e AS (SELECT series_id, date AS event_date, pos, close AS base FROM a WHERE {{cond}}),
ew AS MATERIALIZED (SELECT e.series_id, event_date, CAST(a.pos - e.pos AS INTEGER) AS "offset", date, close, close / base * 100 AS idx, count(close) OVER (PARTITION BY e.series_id, event_date) = 25 AS complete FROM e JOIN a ON e.series_id = a.series_id AND a.pos BETWEEN e.pos - 12 AND e.pos + 12)"""
add("event_window", lambda s, d: tidy(_event_windows(s, d), ["series_id", "event_date", "offset", "date", "complete"], ["index"]), f"{_EWS.format(cond='mm_pct >= 0.95')} SELECT series_id, event_date, \"offset\", date, complete, {r6('idx')} AS index FROM ew")
add("event_mean_path", lambda s, d: tidy(_event_windows(s, d).filter("complete").groupBy("series_id", "offset").agg(F.avg("index").alias("avg"), F.count("*").alias("n")), ["series_id", "offset"], ["avg"], ["n"]), f"{_EWS.format(cond='mm_pct >= 0.95')} SELECT series_id, \"offset\", {r6('avg(idx)')} AS avg, count(*) AS n FROM ew WHERE complete GROUP BY ALL")


def _event_groups(s: SparkSession, d: str) -> DataFrame:
    """Spaced events of each band whose window of 12 rows on both sides is complete: what followed."""
    w = demo.weekly(s, d).withColumn("pos", F.row_number().over(W.by_series())).withColumn("last", F.count("*").over(W.Window.partitionBy("series_id")))
    e = M.spaced_events(events(s, d), 56, ("series_id", "band")).join(w.filter("pos > 12 and pos + 12 <= last"), ["series_id", "date"])
    win = lambda c: F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double")))
    out = e.groupBy("series_id", "band").agg(F.count("*").alias("n"), F.avg("f4").alias("avg4"), F.avg("f8").alias("avg8"), win("f4").alias("win4"), win("f8").alias("win8"), F.max("f8").alias("best"), F.min("f8").alias("worst"))
    return tidy(out, ["series_id", "band"], ["avg4", "avg8", "win4", "win8", "best", "worst"], ["n"])


add("event_group_stats", _event_groups, f"""{_KEPT}, a AS MATERIALIZED (SELECT *, row_number() OVER ({P} ORDER BY date) AS pos, count(*) OVER ({P}) AS last FROM weekly)
SELECT series_id, band, {r6('avg(f4)')} AS avg4, {r6('avg(f8)')} AS avg8, {r6('avg(CAST(f4 > 0 AS INTEGER))')} AS win4, {r6('avg(CAST(f8 > 0 AS INTEGER))')} AS win8, {r6('max(f8)')} AS best, {r6('min(f8)')} AS worst, count(*) AS n FROM kept JOIN a USING (series_id, date) WHERE pos > 12 AND pos + 12 <= last GROUP BY ALL""")
_FLAG = "abs(r1) >= 0.8"
_ISL = lambda gap: f"f AS (SELECT series_id, date, CASE WHEN date - lag(date) OVER ({P} ORDER BY date) <= {gap} THEN 0 ELSE 1 END AS new FROM weekly WHERE {_FLAG}), g AS (SELECT *, CAST(sum(new) OVER ({P} ORDER BY date) AS BIGINT) AS island FROM f)"
add("date_islands", lambda s, d: M.islands(demo.weekly(s, d).filter(_FLAG), 14), f"{FULL}, {_ISL(14)} SELECT series_id, island, min(date) AS start_date, max(date) AS end_date, count(*) AS n FROM g GROUP BY ALL")
add("case_clusters", lambda s, d: M.islands(cases(s, d), 56).groupBy("series_id").agg(F.count("*").alias("clusters"), F.max("n").alias("largest")), f"{CASES}, f AS (SELECT series_id, date, CASE WHEN date - lag(date) OVER ({P} ORDER BY date) <= 56 THEN 0 ELSE 1 END AS new FROM cases), g AS (SELECT *, sum(new) OVER ({P} ORDER BY date) AS island FROM f) SELECT series_id, count(*) AS clusters, max(n) AS largest FROM (SELECT series_id, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL")
add("state_counts", lambda s, d: demo.lifecycle(s, d).groupBy("series_id", "lifecycle_state").agg(F.count("*").alias("n")), f"{LIFE} SELECT series_id, lifecycle_state, count(*) AS n FROM life GROUP BY ALL")
