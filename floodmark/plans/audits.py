"""Queries that compare definitions of one signal: audits, splits, scorecards, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import stats as S
from ..operators import windows as W
from ..sources.paths import stored
from . import demo
from .sql import DEFS, r6
from .studies import CLOSED, FLOORED, H, _change_sql, corr_sql, spread_sql, tidy, unpivot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NAMES = ("mm_net", "producer_net", "oi")
KINDS = ("p52", "p104", "p156", "full", "z52", "z156")
SIGNALS = {f"{f}__{k}": f"{f}__{k}" for f in NAMES for k in KINDS}
SHARES = {k: k for k in SIGNALS if "__z" not in k}
MM = {k: k for k in SHARES if k.startswith("mm_")}
_K = ["series_id", "feature", "horizon"]
_KS = ", ".join(_K)


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    QUERIES[name], ORACLES[name] = run, oracle


def signal_pairs(s: SparkSession, d: str, seg: str | None = None, frame: DataFrame | None = None) -> DataFrame:
    part = ["series_id", *([seg] if seg else [])]
    return S.factor_study(demo.definitions(s, d) if frame is None else frame, SIGNALS, "close", H, part)


def signal_bucket(rows: DataFrame, keys: list[str], rank_shares: bool = False) -> DataFrame:
    """rows with bucket: shares by closed deciles, scores by equal numbers of rows (rank_shares: shares too)."""
    w = Window.partitionBy(*keys)
    rank = C.rank_decile(F.row_number().over(w.orderBy("x", "date")), F.count(F.lit(1)).over(w))
    rank = F.when(F.min("x").over(w) < F.max("x").over(w), rank)
    return rows.withColumn("bucket", rank if rank_shares else F.when(F.col("feature").contains("__z"), rank).otherwise(C.decile_closed_right("x")))


def segment(seg: str | None) -> str:
    part = f"series_id, {seg}" if seg else "series_id"
    w = f"PARTITION BY {part} ORDER BY date"
    fr = lambda h: f"list(close) OVER ({w} ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)"
    y = ", ".join(f"lead(close, {h}) OVER ({w}) / close - 1 AS y{h}" for h in H)
    z = ", ".join(f"CASE WHEN len({fr(h)}) = {h + 1} THEN list_min(list_transform(range(1, {h + 2}), lambda i: {fr(h)}[i] / list_max({fr(h)}[1:i]) - 1)) END AS z{h}" for h in H)
    k = f"{part}, feature, horizon"
    n, r = f"count(*) OVER (PARTITION BY {k})", f"row_number() OVER (PARTITION BY {k} ORDER BY x, date)"
    rank = f"CASE WHEN min(x) OVER (PARTITION BY {k}) < max(x) OVER (PARTITION BY {k}) THEN greatest(0, (({r} - 1) * 10 + {n} - 2) // greatest({n} - 1, 1) - 1) + 1 END"
    long = unpivot("sg", f"{part}, date", SIGNALS, {h: f"y{h}" for h in H}, {h: f"z{h}" for h in H})
    return f"""{DEFS}, sg AS MATERIALIZED (SELECT *, {y}, {z} FROM defs), lg AS MATERIALIZED ({long}),
v AS MATERIALIZED (SELECT * FROM lg WHERE x IS NOT NULL AND y IS NOT NULL), vb AS MATERIALIZED (SELECT *, CAST(CASE WHEN contains(feature, '__z') THEN {rank} ELSE {CLOSED} END AS INTEGER) AS bucket, CAST({rank} AS INTEGER) AS rbucket FROM v)"""


def _floor_buckets(s: SparkSession, d: str) -> DataFrame:
    rows = S.solid(S.pairs(demo.definitions(s, d), MM, {h: f"r{h}" for h in H}, ["series_id", "date"])).withColumn("bucket", C.decile_floor("x"))
    out = rows.groupBy(*_K, "bucket").agg(F.count("*").alias("n"), F.avg("y").alias("avg"), F.median("y").alias("median"), S.win().alias("win"), F.max("y").alias("best"), F.min("y").alias("worst"))
    return tidy(out, [*_K, "bucket"], ["avg", "median", "win", "best", "worst"], ["n"])


_AGG = f"{r6('avg(y)')} AS avg, {r6('median(y)')} AS median, {r6('avg(CAST(y > 0 AS INTEGER))')} AS win, {r6('max(y)')} AS best, {r6('min(y)')} AS worst"
_MML = f"{DEFS}, l AS MATERIALIZED ({unpivot('defs', 'series_id, date, split', MM, {h: f'r{h}' for h in H})})"
add("definition_bucket_stats", _floor_buckets, f"{_MML} SELECT {_KS}, {FLOORED} AS bucket, {_AGG}, count(*) AS n FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL")


def _signal_drawdown(s: SparkSession, d: str) -> DataFrame:
    out = signal_bucket(S.solid(signal_pairs(s, d)), _K).groupBy(*_K, "bucket").agg(
        F.count("*").alias("n"), F.avg("y").alias("avg"), F.median("y").alias("median"), S.win().alias("win"), F.max("y").alias("best"), F.min("y").alias("worst"), F.min("z").alias("drawdown")
    )
    return tidy(out, [*_K, "bucket"], ["avg", "median", "win", "best", "worst", "drawdown"], ["n"])


add("signal_bucket_drawdown", _signal_drawdown, f"{segment(None)} SELECT {_KS}, bucket, {_AGG}, {r6('min(z)')} AS drawdown, count(*) AS n FROM vb GROUP BY ALL")


def information(rows: DataFrame, keys: list[str], rank_shares: bool = False) -> DataFrame:
    """keys: rank correlation, top less bottom bucket, monotonicity, buckets with positive and negative means, rows present and missing."""
    fine = signal_bucket(S.solid(rows), keys, rank_shares)
    means = fine.filter("bucket is not null").groupBy(*keys, "bucket").agg(F.avg("y").alias("avg"))
    by = means.groupBy(*keys).agg((F.max(F.when(F.col("bucket") == 10, F.col("avg"))) - F.max(F.when(F.col("bucket") == 1, F.col("avg")))).alias("spread"), F.count_if(F.col("avg") > 0).alias("n_up"), F.count_if(F.col("avg") < 0).alias("n_down"))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    out = total.join(S.correlations(rows, keys, 3), keys, "left").join(by, keys, "left").join(S.monotonicity(means, keys), keys, "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(*keys, "pearson", "spearman", "spread", "monotonicity", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_up", "n_down")], n.alias("n"), (F.col("__all") - n).alias("missing"))


def info_sql(keys: str, bucket: str = "bucket") -> str:
    return f"""{corr_sql('v', keys, 3, 'ic')}, bm AS MATERIALIZED (SELECT {keys}, {bucket} AS bucket, avg(y) AS a FROM vb WHERE {bucket} IS NOT NULL GROUP BY ALL), bm2 AS (SELECT {keys}, CAST(bucket AS DOUBLE) AS x, a AS y FROM bm), {corr_sql('bm2', keys, 4, 'mo')},
by_ AS (SELECT {keys}, max(CASE WHEN bucket = 10 THEN a END) - max(CASE WHEN bucket = 1 THEN a END) AS spread, count(*) FILTER (a > 0) AS n_up, count(*) FILTER (a < 0) AS n_down FROM bm GROUP BY ALL),
info AS MATERIALIZED (SELECT t.*, ic.p AS pearson, ic.s AS spearman, spread, mo.s AS monotonicity, coalesce(n_up, 0) AS n_up, coalesce(n_down, 0) AS n_down, coalesce(ic.n, 0) AS n, all_ - coalesce(ic.n, 0) AS missing FROM (SELECT {keys}, count(*) AS all_ FROM lg GROUP BY ALL) t LEFT JOIN ic USING ({keys}) LEFT JOIN by_ USING ({keys}) LEFT JOIN mo USING ({keys}))"""


_I = ["spearman", "spread", "monotonicity"]
_ISEL = f"{', '.join(f'{r6(c)} AS {c}' for c in _I)}, n_up, n_down, n, missing FROM info"
add("information_compare", lambda s, d: tidy(information(signal_pairs(s, d), _K), _K, _I, ["n_up", "n_down", "n", "missing"]), f"{segment(None)}, {info_sql(_KS)} SELECT {_KS}, {_ISEL}")
_KT = ["series_id", "split", "feature", "horizon"]
add("signal_train_test", lambda s, d: tidy(information(signal_pairs(s, d, "split"), _KT, True), _KT, _I, ["n_up", "n_down", "n", "missing"]), f"{segment('split')}, {info_sql(', '.join(_KT), 'rbucket')} SELECT {', '.join(_KT)}, {_ISEL}")


def _detail(s: SparkSession, d: str, frame: DataFrame | None = None) -> DataFrame:
    frame = stored(demo.definitions(s, d), "definitions") if frame is None else frame  # read several times
    pairs = signal_pairs(s, d, frame=frame).filter(~F.col("feature").contains("__z"))
    rows = S.solid(pairs)
    t = S.tails(rows, _K, C.decile_closed_right("x"))
    deciles = rows.groupBy(*_K).agg(F.count_distinct(C.decile_closed_right("x")).alias("deciles"))
    return information(pairs, _K).drop("spread").join(t, _K, "left").join(deciles, _K, "left")


_DT = ["spearman", "pearson", "monotonicity", "tail_spread", "tail_t", "avg_low", "avg_high"]


def tail_sql(keys: str, source: str, bucket: str) -> str:
    b = lambda k: f"FILTER ({bucket} = {k})"
    return f"""tl0 AS (SELECT {keys}, count(*) {b(1)} AS n_low, count(*) {b(10)} AS n_high, avg(y) {b(1)} AS avg_low, avg(y) {b(10)} AS avg_high, var_samp(y) {b(1)} AS vl, var_samp(y) {b(10)} AS vh, avg(CAST(y > 0 AS INTEGER)) {b(1)} AS win_low, avg(CAST(y > 0 AS INTEGER)) {b(10)} AS win_high, count(DISTINCT {bucket}) AS deciles FROM {source} GROUP BY ALL),
tl AS MATERIALIZED (SELECT *, avg_high - avg_low AS tail_spread, CASE WHEN n_low >= 2 AND n_high >= 2 AND vh / n_high + vl / n_low > 0 THEN (avg_high - avg_low) / sqrt(vh / n_high + vl / n_low) END AS tail_t FROM tl0)"""


_DETAIL = f"{segment(None)}, {info_sql(_KS)}, {tail_sql(_KS, 'vb', 'bucket')}, detail AS MATERIALIZED (SELECT info.* EXCLUDE (spread), tail_spread, tail_t, avg_low, avg_high, n_low, n_high, deciles FROM info LEFT JOIN tl USING ({_KS}) WHERE NOT contains(feature, '__z'))"
add("definition_detail", lambda s, d: tidy(_detail(s, d), _K, _DT, ["n", "deciles", "n_low", "n_high"]), f"{_DETAIL} SELECT {_KS}, {', '.join(f'{r6(c)} AS {c}' for c in _DT)}, n, deciles, n_low, n_high FROM detail")
_ST = ["coverage", "change_median", "change_p95", "change_sd"]
_STAB = _change_sql("defs", "series_id", SHARES)
add("definition_stability", lambda s, d: tidy(S.change_stats(demo.definitions(s, d), SHARES, ["series_id"]), ["series_id", "feature"], _ST, ["n", "deciles"]), f"{DEFS}, {_STAB} SELECT series_id, feature, {', '.join(f'{r6(c)} AS {c}' for c in _ST)}, n, deciles FROM cs")


def definition_summary(s: SparkSession, d: str) -> DataFrame:
    """Percent ranks of the measures within factor and horizon, of stability within factor, and their means."""
    frame = stored(demo.definitions(s, d), "definitions")
    det = _detail(s, d, frame).withColumn("factor", F.split("feature", "__")[0])
    measures = {"spearman": "a1", "monotonicity": "a2", "tail_t": "a3"}
    det = det.withColumns({a: F.round(F.abs(c), 9) for c, a in measures.items()})
    part = ["series_id", "factor", "horizon"]
    mean = lambda cols: F.aggregate(F.filter(F.array(*cols), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x) / F.size(F.filter(F.array(*cols), lambda x: x.isNotNull()))
    det = det.withColumn("information", mean([W.percent_rank_average(c, part) for c in ("a1", "a2", "a3", "n", "deciles")]))
    info = det.groupBy("series_id", "factor", "feature").agg(F.avg("information").alias("info_all"), F.avg(F.when(F.col("horizon") >= 4, F.col("information"))).alias("info_long"))
    st = S.change_stats(frame, SHARES, ["series_id"]).withColumn("factor", F.split("feature", "__")[0])
    st = st.withColumns({c: F.round(c, 9) for c in ("coverage", "change_median", "change_p95")})
    own = ["series_id", "factor"]
    st = st.withColumn("stability", mean([W.percent_rank_average("coverage", own), W.percent_rank_average("deciles", own), W.percent_rank_average("change_median", own, True), W.percent_rank_average("change_p95", own, True)]))
    out = info.join(st.select("series_id", "feature", "stability"), ["series_id", "feature"])
    return out.withColumn("overall", (F.col("stability") + F.col("info_all") + F.col("info_long")) / 3)


def _share(x: str, part: str, desc: bool = False) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part}, {x} IS NULL ORDER BY {x} {'DESC' if desc else 'ASC'}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY {part}, {x} IS NULL) END"


_P3 = "series_id, factor, horizon"
_SUM = f"""{_DETAIL}, {_STAB}, d1 AS (SELECT *, split_part(feature, '__', 1) AS factor, round(abs(spearman), 9) AS a1, round(abs(monotonicity), 9) AS a2, round(abs(tail_t), 9) AS a3 FROM detail),
d2 AS (SELECT *, list_avg(list_filter([{', '.join(_share(c, _P3) for c in ('a1', 'a2', 'a3', 'n', 'deciles'))}], lambda q: q IS NOT NULL)) AS information FROM d1),
d3 AS (SELECT series_id, factor, feature, avg(information) AS info_all, avg(information) FILTER (horizon >= 4) AS info_long FROM d2 GROUP BY ALL),
s1 AS (SELECT series_id, feature, split_part(feature, '__', 1) AS factor, round(coverage, 9) AS coverage, deciles, round(change_median, 9) AS change_median, round(change_p95, 9) AS change_p95 FROM cs),
s2 AS (SELECT series_id, feature, list_avg(list_filter([{_share('coverage', 'series_id, factor')}, {_share('deciles', 'series_id, factor')}, {_share('change_median', 'series_id, factor', True)}, {_share('change_p95', 'series_id, factor', True)}], lambda q: q IS NOT NULL)) AS stability FROM s1),
summ AS MATERIALIZED (SELECT *, (stability + info_all + info_long) / 3 AS overall FROM d3 JOIN s2 USING (series_id, feature))"""
_SC = ["info_all", "info_long", "stability", "overall"]
add("definition_summary", lambda s, d: tidy(definition_summary(s, d), ["series_id", "factor", "feature"], _SC), f"{_SUM} SELECT series_id, factor, feature, {', '.join(f'{r6(c)} AS {c}' for c in _SC)} FROM summ")


def _recommend(s: SparkSession, d: str) -> DataFrame:
    """The best rolling definition of each factor, and the one that is best over all factors of a series; ties by name."""
    safe = definition_summary(s, d).filter(~F.col("feature").endswith("__full")).withColumns({"kind": F.split("feature", "__")[1], "o": F.round("overall", 9)})
    best = safe.groupBy("series_id", "factor").agg(F.min(F.struct((-F.col("o")).alias("o"), "kind")).alias("b"))
    mean = safe.groupBy("series_id", "kind").agg(F.round(F.avg("overall"), 9).alias("m"))
    one = mean.groupBy("series_id").agg(F.min(F.struct((-F.col("m")).alias("m"), "kind")).alias("u"))
    return best.join(one, "series_id").select("series_id", "factor", F.col("b.kind").alias("definition"), C.r6(-F.col("b.o")).alias("score"), F.col("u.kind").alias("unified"), C.r6(-F.col("u.m")).alias("unified_score"))


add("definition_recommend", _recommend, f"""{_SUM}, sf AS (SELECT *, split_part(feature, '__', 2) AS kind, round(overall, 9) AS o FROM summ WHERE NOT ends_with(feature, '__full')),
bb AS (SELECT series_id, factor, arg_min(kind, (-o, kind)) AS definition, {r6('max(o)')} AS score FROM sf GROUP BY ALL), mm AS (SELECT series_id, kind, round(avg(overall), 9) AS m FROM sf GROUP BY ALL),
uu AS (SELECT series_id, arg_min(kind, (-m, kind)) AS unified, {r6('max(m)')} AS unified_score FROM mm GROUP BY ALL) SELECT * FROM bb JOIN uu USING (series_id)""")


def mm_compare(s: SparkSession, d: str) -> DataFrame:
    """One factor's definitions on trailing returns with floor deciles: correlation (20 rows at least), spread, coverage, changes."""
    rows = S.pairs(demo.definitions(s, d), MM, {h: f"r{h}" for h in H}, ["series_id", "date"])
    out = S.correlations(rows, _K, 20).select(*_K, "n", F.col("spearman").alias("rank_corr")).join(S.tails(S.solid(rows), _K, C.decile_floor("x")).select(*_K, "tail_spread"), _K)
    return out.join(S.change_stats(demo.definitions(s, d), MM, ["series_id"]).select("series_id", "feature", "coverage", "change_median", "change_p95"), ["series_id", "feature"])


_MC = ["rank_corr", "tail_spread", "coverage", "change_median", "change_p95"]
_CMP = f"{_MML}, {corr_sql('l', _KS, 20, 'mc')}, lf AS (SELECT *, {FLOORED} AS bucket FROM l WHERE x IS NOT NULL AND y IS NOT NULL), {tail_sql(_KS, 'lf', 'bucket')}, {_change_sql('defs', 'series_id', MM)}, cmp AS MATERIALIZED (SELECT series_id, feature, horizon, mc.n AS n, mc.s AS rank_corr, tail_spread, coverage, change_median, change_p95 FROM mc JOIN tl USING ({_KS}) JOIN cs USING (series_id, feature))"
add("mm_definition_compare", lambda s, d: tidy(mm_compare(s, d), _K, _MC, ["n"]), f"{_CMP} SELECT {_KS}, {', '.join(f'{r6(c)} AS {c}' for c in _MC)}, n FROM cmp")


def mm_splits(s: SparkSession, d: str) -> DataFrame:
    rows = S.pairs(demo.definitions(s, d), MM, {h: f"r{h}" for h in H}, ["series_id", "split", "date"])
    return S.correlations(rows, _KT, 20).join(S.quantile_spread(rows, _KT), _KT).join(S.tails(S.solid(rows), _KT, C.decile_closed_right("x")).drop("tail_spread", "tail_t"), _KT)


_MT = ["spearman", "spread", "win_low", "win_high", "avg_low", "avg_high"]
_SPL = f"{corr_sql('l', ', '.join(_KT), 20, 'mt')}, {spread_sql('l', ', '.join(_KT), 'ms')}, lc AS (SELECT *, {CLOSED} AS bucket FROM l WHERE x IS NOT NULL AND y IS NOT NULL), {tail_sql(', '.join(_KT), 'lc', 'bucket').replace('tl0', 'tm0').replace('tl AS', 'tm AS')}"
add("mm_train_test", lambda s, d: tidy(mm_splits(s, d), _KT, _MT, ["n"]), f"{_MML}, {_SPL} SELECT {', '.join(_KT)}, {r6('mt.s')} AS spearman, {', '.join(f'{r6(c)} AS {c}' for c in _MT[1:])}, mt.n AS n FROM mt JOIN ms USING ({', '.join(_KT)}) JOIN tm USING ({', '.join(_KT)})")


def mm_scorecard(s: SparkSession, d: str) -> DataFrame:
    """Per horizon: ranks of correlation and spread, 1 - change / largest change, train and test signs, weights; the best rolling definition is marked."""
    part = ["series_id", "horizon"]
    w = Window.partitionBy(*part)
    c = mm_compare(s, d).withColumns({"a": F.round(F.abs("rank_corr"), 9), "b": F.round(F.abs("tail_spread"), 9), "safe": ~F.col("feature").endswith("__full")})
    t = mm_splits(s, d)
    t = t.groupBy(*_K).agg(*[F.max(F.when(F.col("split") == k, F.col("spearman"))).alias(f"{k}_corr") for k in ("train", "test")])
    c = c.join(t, _K, "left")
    p = F.col("train_corr") * F.col("test_corr")
    weight = F.create_map(*[F.lit(x) for kv in ((1, 0.75), (2, 0.85), (4, 1.0), (8, 1.0)) for x in kv])[F.col("horizon")]
    longer = F.avg(F.when(F.col("safe") & ~F.col("feature").endswith("__p52"), F.col("change_median"))).over(Window.partitionBy("series_id"))
    short = F.max(F.when(F.col("feature").endswith("__p52"), F.col("change_median"))).over(Window.partitionBy("series_id"))
    top = F.max("change_median").over(w)
    c = c.withColumns({
        "information": (0.60 * F.coalesce(W.percent_rank_average("a", part), F.lit(0.0)) + 0.40 * F.coalesce(W.percent_rank_average("b", part), F.lit(0.0))) * 100 * weight,
        "stability": F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("change_median") / top)) * 100).otherwise(100.0),
        "split_score": F.when(p > 0, 100.0).when(p == 0, 50.0).otherwise(0.0),
        "reading": F.when(F.col("safe"), 90.0).otherwise(55.0) - F.when(F.col("feature").endswith("__p52") & (short > longer), 15.0).otherwise(0.0),
    })
    c = c.withColumn("total", 0.40 * F.col("information") + 0.20 * F.col("stability") + 0.20 * F.col("split_score") + 0.20 * F.col("reading"))
    first = F.row_number().over(w.orderBy(F.desc("safe"), F.desc(F.round("total", 9)), "feature"))
    return c.withColumn("recommended", F.col("safe") & (first == 1))


_SCORE = f"""{_CMP}, {_SPL}, t1 AS (SELECT {_KS}, max(CASE WHEN split = 'train' THEN s END) AS train_corr, max(CASE WHEN split = 'test' THEN s END) AS test_corr FROM mt GROUP BY ALL),
sc0 AS (SELECT cmp.*, train_corr, test_corr, round(abs(rank_corr), 9) AS a, round(abs(tail_spread), 9) AS b, NOT ends_with(feature, '__full') AS safe FROM cmp LEFT JOIN t1 USING ({_KS})),
sc1 AS (SELECT *, (0.60 * coalesce({_share('a', 'series_id, horizon')}, 0) + 0.40 * coalesce({_share('b', 'series_id, horizon')}, 0)) * 100 * CASE horizon WHEN 1 THEN 0.75 WHEN 2 THEN 0.85 ELSE 1.0 END AS information,
CASE WHEN max(change_median) OVER (PARTITION BY series_id, horizon) > 0 THEN greatest(0.0, least(1.0, 1 - change_median / max(change_median) OVER (PARTITION BY series_id, horizon))) * 100 ELSE 100.0 END AS stability,
CASE WHEN train_corr * test_corr > 0 THEN 100.0 WHEN train_corr * test_corr = 0 THEN 50.0 ELSE 0.0 END AS split_score,
CASE WHEN safe THEN 90.0 ELSE 55.0 END - CASE WHEN ends_with(feature, '__p52') AND max(change_median) FILTER (ends_with(feature, '__p52')) OVER (PARTITION BY series_id) > avg(change_median) FILTER (safe AND NOT ends_with(feature, '__p52')) OVER (PARTITION BY series_id) THEN 15.0 ELSE 0.0 END AS reading FROM sc0),
sc2 AS (SELECT *, 0.40 * information + 0.20 * stability + 0.20 * split_score + 0.20 * reading AS total FROM sc1),
sc AS MATERIALIZED (SELECT *, safe AND row_number() OVER (PARTITION BY series_id, horizon ORDER BY safe DESC, round(total, 9) DESC, feature) = 1 AS recommended FROM sc2)"""
_MS = ["information", "stability", "split_score", "reading", "total"]
add("mm_definition_scorecard", lambda s, d: tidy(mm_scorecard(s, d), [*_K, "recommended"], _MS), f"{_SCORE} SELECT {_KS}, recommended, {', '.join(f'{r6(c)} AS {c}' for c in _MS)} FROM sc")


def _mm_summary(s: SparkSession, d: str) -> DataFrame:
    long = F.when(F.col("horizon") >= 4, F.col("total"))
    out = mm_scorecard(s, d).groupBy("series_id", "feature").agg(F.avg("total").alias("total"), F.avg("information").alias("information"), F.avg("split_score").alias("split_score"), F.avg(long).alias("total_long"), F.count_if("recommended").alias("n_recommended"))
    return tidy(out, ["series_id", "feature"], ["total", "information", "split_score", "total_long"], ["n_recommended"])


add("mm_definition_score_summary", _mm_summary, f"{_SCORE} SELECT series_id, feature, {r6('avg(total)')} AS total, {r6('avg(information)')} AS information, {r6('avg(split_score)')} AS split_score, {r6('avg(total) FILTER (horizon >= 4)')} AS total_long, count(*) FILTER (recommended) AS n_recommended FROM sc GROUP BY ALL")


def _signal_scorecard(s: SparkSession, d: str) -> DataFrame:
    """Scores in train and test from clipped measures, and the stability of both; the best of each factor and horizon that may be used live."""
    i = information(signal_pairs(s, d, "split"), _KT, True)
    i = i.withColumns({
        "rank": F.least(F.coalesce(F.abs("spearman"), F.lit(0.0)) / 0.10, F.lit(1.0)) * 100, "mono": F.least(F.coalesce(F.abs("monotonicity"), F.lit(0.0)), F.lit(1.0)) * 100,
        "cover": F.coalesce(F.try_divide("n", F.col("n") + F.col("missing")), F.lit(0.0)) * 100, "sign": F.when(F.abs("spread") < 1e-12, 0).otherwise(F.coalesce(F.signum("spread"), F.lit(0))),
    })
    read = F.when(F.col("feature").endswith("__full"), 60.0).when(F.col("feature").contains("__z"), 80.0).otherwise(90.0)
    side = lambda k, c: F.max(F.when(F.col("split") == k, F.col(c))).alias(f"{k}_{c}")
    o = i.groupBy(*_K).agg(*[side(k, c) for k in ("train", "test") for c in ("rank", "mono", "cover", "sign")]).withColumn("reading", read)
    score = lambda k: (25 * F.col(f"{k}_rank") + 20 * F.col(f"{k}_mono") + 15 * F.col(f"{k}_cover") + 10 * F.col("reading")) / 70
    p = F.col("train_sign") * F.col("test_sign")
    half = lambda c: (F.col(f"train_{c}") + F.col(f"test_{c}")) / 2
    o = o.withColumns({"train": score("train"), "test": score("test"), "stability": 0.30 * F.when(p == 0, 50.0).when(p > 0, 100.0).otherwise(0.0) + 0.25 * half("rank") + 0.20 * half("mono") + 0.15 * half("cover") + 0.10 * F.col("reading")})
    w = Window.partitionBy("series_id", F.split("feature", "__")[0], "horizon").orderBy(F.col("feature").endswith("__full"), F.desc(F.round("stability", 6)), "feature")
    return tidy(o.withColumn("recommended", F.row_number().over(w) == 1), [*_K, "recommended"], ["train", "test", "stability"])


_SG = "CASE WHEN spread IS NULL OR abs(spread) < 1e-12 THEN 0 ELSE sign(spread) END"
add("signal_scorecard", _signal_scorecard, f"""{segment('split')}, {info_sql(', '.join(_KT), 'rbucket')}, g0 AS (SELECT {', '.join(_KT)}, least(coalesce(abs(spearman), 0) / 0.10, 1) * 100 AS rank_, least(coalesce(abs(monotonicity), 0), 1) * 100 AS mono, n / CAST(n + missing AS DOUBLE) * 100 AS cover, {_SG} AS sg FROM info),
g1 AS (SELECT {_KS}, {', '.join(f"max(CASE WHEN split = '{k}' THEN {c} END) AS {k}_{c}" for k in ('train', 'test') for c in ('rank_', 'mono', 'cover', 'sg'))}, CASE WHEN ends_with(feature, '__full') THEN 60.0 WHEN contains(feature, '__z') THEN 80.0 ELSE 90.0 END AS reading FROM g0 GROUP BY ALL),
g2 AS (SELECT *, (25 * train_rank_ + 20 * train_mono + 15 * train_cover + 10 * reading) / 70 AS train, (25 * test_rank_ + 20 * test_mono + 15 * test_cover + 10 * reading) / 70 AS test,
0.30 * CASE WHEN train_sg * test_sg = 0 THEN 50.0 WHEN train_sg * test_sg > 0 THEN 100.0 ELSE 0.0 END + 0.25 * (train_rank_ + test_rank_) / 2 + 0.20 * (train_mono + test_mono) / 2 + 0.15 * (train_cover + test_cover) / 2 + 0.10 * reading AS stability FROM g1)
SELECT {_KS}, row_number() OVER (PARTITION BY series_id, split_part(feature, '__', 1), horizon ORDER BY ends_with(feature, '__full'), round(stability, 6) DESC, feature) = 1 AS recommended, {r6('train')} AS train, {r6('test')} AS test, {r6('stability')} AS stability FROM g2""")
