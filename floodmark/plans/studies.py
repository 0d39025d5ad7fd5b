"""Queries of the research tables: outcomes by bucket and state, lead-lag, audits, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import stats as S
from ..operators import windows as W
from ..sources.paths import stored
from . import demo, sql
from .sql import DEFS, FULL, LIFE, STRUCT, r6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FACTORS = {k: f"{k}_pct" for k in ("mm", "producer", "swap", "oi")}
H = demo.HORIZONS
TRAIL = {h: f"r{h}" for h in H}
FORWARD = {h: f"f{h}" for h in H}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str) -> None:
    QUERIES[name], ORACLES[name] = run, oracle


def tidy(df: DataFrame, keys: list[str], doubles: list[str], other: list[str] | None = None) -> DataFrame:
    return df.select(*keys, *[C.r6(c).alias(c) for c in doubles], *[F.col(c).cast("long").alias(c) for c in other or []])


# --- outcomes by decile -------------------------------------------------------

CLOSED = "CASE " + " ".join(f"WHEN least(greatest(x, 0.0), 1.0) <= {k / 10} THEN {k}" for k in range(1, 10)) + " ELSE 10 END"
FLOORED = "CAST(least(floor(x * 10), 9) AS INTEGER) + 1"


def unpivot(source: str, keys: str, features: dict[str, str], returns: dict[int, str], extra: dict[int, str] | None = None) -> str:
    """SQL of stats.pairs."""
    f = ", ".join(f"{{'feature': '{n}', 'x': CAST({c} AS DOUBLE)}}" for n, c in features.items())
    r = ", ".join(f"{{'horizon': {h}, 'y': CAST({c} AS DOUBLE){f", 'z': {extra[h]}" if extra else ''}}}" for h, c in returns.items())
    third = ", r.z AS z" if extra else ""
    return f"SELECT {keys}, f.feature AS feature, f.x AS x, r.horizon AS horizon, r.y AS y{third} FROM (SELECT *, unnest([{r}]) AS r FROM (SELECT *, unnest([{f}]) AS f FROM {source}))"


def segment_sql(seg: str | None) -> str:
    part = f"series_id, {seg}" if seg else "series_id"
    w = f"PARTITION BY {part} ORDER BY date"
    fr = lambda h: f"list(close) OVER ({w} ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)"
    y = ", ".join(f"lead(close, {h}) OVER ({w}) / close - 1 AS y{h}" for h in H)
    z = ", ".join(f"CASE WHEN len({fr(h)}) = {h + 1} THEN list_min(list_transform(range(1, {h + 2}), lambda i: {fr(h)}[i] / list_max({fr(h)}[1:i]) - 1)) END AS z{h}" for h in H)
    long = unpivot("s", part, FACTORS, {h: f"y{h}" for h in H}, {h: f"z{h}" for h in H})
    return f"""{FULL}, s AS MATERIALIZED (SELECT *, {y}, {z} FROM weekly), l AS MATERIALIZED ({long}),
k AS (SELECT DISTINCT {part}, feature, horizon, unnest(range(1, 11)) AS bucket FROM l),
g AS (SELECT {part}, feature, horizon, {CLOSED} AS bucket, count(y) AS n, avg(y) AS a, median(y) AS m, avg(CASE WHEN y IS NOT NULL THEN CAST(y > 0 AS INTEGER) END) AS w, max(y) AS b, min(y) AS c, min(z) AS d FROM l WHERE x IS NOT NULL GROUP BY ALL),
t AS MATERIALIZED (SELECT {part}, feature, horizon, CAST(bucket AS INTEGER) AS bucket, coalesce(n, 0) AS n, a, m, w, b, c, d FROM k LEFT JOIN g USING ({part}, feature, horizon, bucket))"""


def bucket_table(s: SparkSession, d: str, seg: str | None = None) -> DataFrame:
    part = ["series_id", seg] if seg else ["series_id"]
    long = S.factor_study(demo.weekly(s, d), FACTORS, "close", H, part)
    return S.bucket_stats(long, [*part, "feature", "horizon"], C.decile_closed_right("x"), extremes=True, drawdown=True)


def _buckets(seg: str | None):
    keys = ["series_id", *([seg] if seg else []), "feature", "horizon", "bucket"]
    run = lambda s, d: tidy(bucket_table(s, d, seg), keys, ["avg", "median", "win", "drawdown"], ["n"])
    return run, f"{segment_sql(seg)} SELECT {', '.join(keys)}, {r6('a')} AS avg, {r6('m')} AS median, {r6('w')} AS win, {r6('d')} AS drawdown, n FROM t"


add("factor_bucket_stats", *_buckets(None))
add("factor_bucket_split", *_buckets("split"))
add("factor_bucket_regime", *_buckets("regime"))


def predictive(df: DataFrame, keys: list[str]) -> DataFrame:
    """For each key over its buckets: rank correlation with the mean, top less bottom, best and worst bucket, clear buckets, grade."""
    df = df.withColumn("up", (F.col("n") >= 30) & (F.col("avg") > 0) & (F.col("median") > 0) & (F.col("win") >= 0.55))
    df = df.withColumn("down", (F.col("n") >= 30) & (F.col("avg") < 0) & (F.col("median") < 0) & (F.col("win") <= 0.45))
    corr = S.correlations(df.select(*keys, (F.col("bucket") * 10.0 - 5).alias("x"), F.col("avg").alias("y")), keys, 2).select(*keys, F.col("spearman").alias("rank_corr"))
    at = lambda b: F.max(F.when(F.col("bucket") == b, F.col("avg")))
    out = df.groupBy(*keys).agg(
        (at(10) - at(1)).alias("spread"), F.min_by(F.when(F.col("avg").isNotNull(), F.col("bucket")), F.struct(-F.col("avg"), "bucket")).alias("__b"),
        F.max("avg").alias("best_avg"), F.min("avg").alias("worst_avg"), F.count_if("up").alias("n_up"), F.count_if("down").alias("n_down"),
        F.min(F.when(F.col("avg").isNotNull(), F.struct((-F.col("avg")).alias("v"), "bucket"))).alias("__best"), F.min(F.when(F.col("avg").isNotNull(), F.struct(F.col("avg").alias("v"), "bucket"))).alias("__worst"),
    )
    out = out.join(corr, keys, "left").withColumns({"best": F.col("__best.bucket"), "worst": F.col("__worst.bucket")}).drop("__b", "__best", "__worst")
    return out.withColumn("grade", C.predictive_grade("rank_corr", "spread", F.col("n_up") + F.col("n_down")))


def avg_rank_sql(x: str, part: str) -> str:
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


def corr_sql(source: str, keys: str, least: int, name: str = "cr") -> str:
    """SQL of stats.correlations as the view name."""
    fine = f"count(*) >= {least} AND min(x) < max(x) AND min(y) < max(y)"
    return f"""{name}0 AS (SELECT {keys}, x, y, {avg_rank_sql('x', keys)} AS rx, {avg_rank_sql('y', keys)} AS ry FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL),
{name} AS MATERIALIZED (SELECT {keys}, count(*) AS n, CASE WHEN {fine} THEN corr(x, y) END AS p, CASE WHEN {fine} THEN corr(rx, ry) END AS s FROM {name}0 GROUP BY ALL)"""


def predictive_sql(keys: str) -> str:
    return f"""q AS (SELECT {keys}, bucket * 10.0 - 5 AS x, a AS y FROM t), {corr_sql('q', keys, 2)},
u AS (SELECT {keys}, max(CASE WHEN bucket = 10 THEN a END) - max(CASE WHEN bucket = 1 THEN a END) AS spread, max(a) AS best_avg, min(a) AS worst_avg,
count(*) FILTER (n >= 30 AND a > 0 AND m > 0 AND w >= 0.55) AS n_up, count(*) FILTER (n >= 30 AND a < 0 AND m < 0 AND w <= 0.45) AS n_down,
arg_min(bucket, (-a, bucket)) FILTER (a IS NOT NULL) AS best, arg_min(bucket, (a, bucket)) FILTER (a IS NOT NULL) AS worst FROM t GROUP BY ALL),
pr AS MATERIALIZED (SELECT u.*, cr.s AS rank_corr, CASE WHEN round(abs(coalesce(cr.s, 0)), 9) >= 0.6 AND abs(coalesce(spread, 0)) >= 0.008 THEN 'strong' WHEN round(abs(coalesce(cr.s, 0)), 9) >= 0.3 AND abs(coalesce(spread, 0)) >= 0.005 THEN 'medium'
WHEN n_up + n_down >= 2 AND abs(coalesce(spread, 0)) >= 0.003 THEN 'weak' ELSE 'none' END AS grade FROM u LEFT JOIN cr USING ({keys}))"""


_PRED = ["rank_corr", "spread", "best_avg", "worst_avg"]
for _name, _seg in (("predictive_summary", None), ("segment_summary", "split"), ("segment_summary_regime", "regime")):
    _keys = ["series_id", *([_seg] if _seg else []), "feature", "horizon"]
    add(_name, lambda s, d, g=_seg, k=_keys: tidy(predictive(bucket_table(s, d, g), k), [*k, "grade"], _PRED, ["best", "worst", "n_up", "n_down"]),
        f"{segment_sql(_seg)}, {predictive_sql(', '.join(_keys))} SELECT {', '.join(_keys)}, grade, {', '.join(f'{r6(c)} AS {c}' for c in _PRED)}, CAST(best AS BIGINT) AS best, CAST(worst AS BIGINT) AS worst, n_up, n_down FROM pr")
_K = ["series_id", "feature", "horizon"]
add("obvious_buckets", lambda s, d: tidy(bucket_table(s, d).filter("n >= 30 and ((avg > 0 and median > 0 and win >= 0.55) or (avg < 0 and median < 0 and win <= 0.45))"), [*_K, "bucket"], ["avg", "median", "win"], ["n"]),
    f"{segment_sql(None)} SELECT series_id, feature, horizon, bucket, {r6('a')} AS avg, {r6('m')} AS median, {r6('w')} AS win, n FROM t WHERE n >= 30 AND ((a > 0 AND m > 0 AND w >= 0.55) OR (a < 0 AND m < 0 AND w <= 0.45))")


def _no_value(s: SparkSession, d: str) -> DataFrame:
    p = predictive(bucket_table(s, d), _K)
    out = p.groupBy("series_id", "feature").agg(F.max(F.col("grade").isin("strong", "medium").cast("int")).alias("any"), F.max(F.abs("rank_corr")).alias("max_corr"), F.max(F.abs("spread")).alias("max_spread"))
    return tidy(out.filter("any = 0"), ["series_id", "feature"], ["max_corr", "max_spread"])


add("no_value_factors", _no_value, f"{segment_sql(None)}, {predictive_sql('series_id, feature, horizon')} SELECT series_id, feature, {r6('max(abs(rank_corr))')} AS max_corr, {r6('max(abs(spread))')} AS max_spread FROM pr GROUP BY ALL HAVING count(*) FILTER (grade IN ('strong', 'medium')) = 0")


def train_test(s: SparkSession, d: str) -> DataFrame:
    """Train beside test: the same direction and a grade in the test makes a pass."""
    p = predictive(bucket_table(s, d, "split"), ["series_id", "split", "feature", "horizon"])
    side = lambda k: p.filter(F.col("split") == k).select(*_K, *[F.col(c).alias(f"{k}_{c}") for c in ("rank_corr", "spread", "grade")])
    out = side("train").join(side("test"), _K)
    same = F.signum("train_rank_corr") * F.signum("test_rank_corr") > 0
    out = out.withColumn("stability", F.when(same & (F.col("test_grade") != "none"), "pass").otherwise("weak"))
    return tidy(out, [*_K, "stability"], ["train_rank_corr", "test_rank_corr", "train_spread", "test_spread"])


add("train_test_compare", train_test, f"""{segment_sql('split')}, {predictive_sql('series_id, split, feature, horizon')} SELECT series_id, feature, horizon, CASE WHEN a.rank_corr * b.rank_corr > 0 AND b.grade <> 'none' THEN 'pass' ELSE 'weak' END AS stability,
{r6('a.rank_corr')} AS train_rank_corr, {r6('b.rank_corr')} AS test_rank_corr, {r6('a.spread')} AS train_spread, {r6('b.spread')} AS test_spread FROM (SELECT * FROM pr WHERE split = 'train') a JOIN (SELECT * FROM pr WHERE split = 'test') b USING (series_id, feature, horizon)""")

# --- outcomes by state --------------------------------------------------------

_RET = ["r1", "r2", "r4", "r8"]
_OUT = [f"{a}_{r}" for r in _RET for a in ("avg", "median", "win")] + ["best", "worst"]


def _states(frame: Callable, state: str, names: tuple[str, ...], with_: str, source: str):
    run = lambda s, d: tidy(S.state_outcomes(frame(s, d), ["series_id"], state, names, _RET), ["series_id", state], _OUT, ["n"])
    aggs = ", ".join(f"{r6(f'avg({r})')} AS avg_{r}, {r6(f'median({r})')} AS median_{r}, {r6(f'avg(CASE WHEN {r} IS NOT NULL THEN CAST({r} > 0 AS INTEGER) END)')} AS win_{r}" for r in _RET)
    values = ", ".join(f"'{x}'" for x in names)
    return run, f"""{with_}, k AS (SELECT DISTINCT series_id, unnest([{values}]) AS {state} FROM {source}), g AS (SELECT series_id, {state}, count(*) AS n0, {aggs}, {r6('max(r8)')} AS best, {r6('min(r8)')} AS worst FROM {source} GROUP BY ALL)
SELECT series_id, {state}, coalesce(n0, 0) AS n, {', '.join(_OUT)} FROM k LEFT JOIN g USING (series_id, {state})"""


add("state_outcomes", *_states(demo.lifecycle, "lifecycle_state", C.LIFECYCLE_STATES, LIFE, "life"))
add("structure_outcomes", *_states(demo.structure, "structure_state", C.STRUCTURE_STATES, STRUCT, "structure"))
add("contribution_outcomes", *_states(demo.structure, "contribution_state", C.CONTRIBUTION_STATES, STRUCT, "structure"))


def _strongest_state(s: SparkSession, d: str) -> DataFrame:
    parts = []
    for kind, frame, state in (("lifecycle", demo.lifecycle, "lifecycle_state"), ("structure", demo.structure, "structure_state"), ("contribution", demo.structure, "contribution_state")):
        m = frame(s, d).groupBy("series_id", F.col(state).alias("state")).agg(F.median("r8").alias("m")).filter("m is not null")
        best = m.groupBy("series_id").agg(F.min(F.struct((-F.abs("m")).alias("a"), "state", "m")).alias("b"))
        parts.append(best.select("series_id", F.lit(kind).alias("kind"), "b.state", C.r6("b.m").alias("median_r8")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SS = lambda kind, src, st: f"SELECT series_id, '{kind}' AS kind, arg_min(state, (-abs(m), state)) AS state, {r6('arg_min(m, (-abs(m), state))')} AS median_r8 FROM (SELECT series_id, {st} AS state, median(r8) AS m FROM {src} GROUP BY ALL) WHERE m IS NOT NULL GROUP BY ALL"
add("strongest_state", _strongest_state, f"{FULL}, {sql.LIFECYCLE}, {sql.STRUCTURE} {_SS('lifecycle', 'life', 'lifecycle_state')} UNION ALL {_SS('structure', 'structure', 'structure_state')} UNION ALL {_SS('contribution', 'structure', 'contribution_state')}")

# --- velocities ---------------------------------------------------------------

GROUPS, WINDOWS = ("long", "short", "net"), (2, 4, 8, 12, 26)
VELOCITY = {f"{g}_v{k}": f"{g}_pct_v{k}" for g in GROUPS for k in WINDOWS}
_VL = f"{STRUCT}, l AS MATERIALIZED ({unpivot('structure', 'series_id, date, split', VELOCITY, TRAIL)})"


def _velocity_pairs(s: SparkSession, d: str) -> DataFrame:
    return S.pairs(demo.structure(s, d), VELOCITY, TRAIL, ["series_id", "date", "split"])


def _velocity_buckets(s: SparkSession, d: str) -> DataFrame:
    rows = S.solid(_velocity_pairs(s, d)).withColumn("bucket", C.velocity_bucket("x"))
    out = rows.groupBy(*_K, "bucket").agg(F.count("*").alias("n"), F.avg("y").alias("avg"), F.median("y").alias("median"), S.win().alias("win"), F.max("y").alias("best"), F.min("y").alias("worst"))
    return tidy(out, [*_K, "bucket"], ["avg", "median", "win", "best", "worst"], ["n"])


_VB = "CASE WHEN x * 100 < -30 THEN 1 WHEN x * 100 < -10 THEN 2 WHEN x * 100 < 0 THEN 3 WHEN x * 100 < 10 THEN 4 WHEN x * 100 < 30 THEN 5 ELSE 6 END"
add("velocity_bucket_stats", _velocity_buckets, f"{_VL} SELECT series_id, feature, horizon, {_VB} AS bucket, {r6('avg(y)')} AS avg, {r6('median(y)')} AS median, {r6('avg(CAST(y > 0 AS INTEGER))')} AS win, {r6('max(y)')} AS best, {r6('min(y)')} AS worst, count(*) AS n FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL")
_CH = ["coverage", "change_avg", "change_median", "change_p95", "change_sd", "change_sd_pop"]


def _change_sql(source: str, keys: str, features: dict[str, str]) -> str:
    long = unpivot(source, f"{keys}, date", features, {0: "0"})
    return f"""c0 AS ({long}), c1 AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY {keys}, feature ORDER BY date)) AS c FROM c0),
cs AS MATERIALIZED (SELECT {keys}, feature, count(x) / CAST(count(*) AS DOUBLE) AS coverage, count(x) AS n, avg(c) AS change_avg, median(c) AS change_median, quantile_cont(c, 0.95) AS change_p95, stddev_samp(c) AS change_sd, stddev_pop(c) AS change_sd_pop,
count(*) FILTER (c > 0.3) AS jumps, count(DISTINCT least(floor(x * 10), 9)) FILTER (x IS NOT NULL) AS deciles FROM c1 GROUP BY ALL)"""


_CSQL = f"SELECT series_id, feature, {', '.join(f'{r6(c)} AS {c}' for c in _CH)}, n, jumps, deciles FROM cs"
add("velocity_stability", lambda s, d: tidy(S.change_stats(demo.structure(s, d), VELOCITY, ["series_id"]), ["series_id", "feature"], _CH, ["n", "jumps", "deciles"]), f"{STRUCT}, {_change_sql('structure', 'series_id', VELOCITY)} {_CSQL}")


def spread_sql(source: str, keys: str, name: str = "sp") -> str:
    return f"""{name}0 AS (SELECT * REPLACE (round(x, 9) AS x) FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL), {name}1 AS (SELECT {keys}, count(*) AS n, round(quantile_cont(x, 0.2), 9) AS lo, round(quantile_cont(x, 0.8), 9) AS hi FROM {name}0 GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, CASE WHEN max(n) >= 20 THEN median(y) FILTER (x >= hi) - median(y) FILTER (x <= lo) END AS spread FROM {name}0 JOIN {name}1 USING ({keys}) GROUP BY ALL)"""


add("quintile_spread", lambda s, d: tidy(S.quantile_spread(_velocity_pairs(s, d), _K), _K, ["spread"]), f"{_VL}, {spread_sql('l', 'series_id, feature, horizon')} SELECT series_id, feature, horizon, {r6('spread')} AS spread FROM sp")


def velocity_splits(pairs: DataFrame) -> DataFrame:
    """Spearman and quintile spread in train and test; consistent where both correlations point the same way (zero counts as either)."""
    keys = ["series_id", "split", "feature", "horizon"]
    rows = pairs
    both = S.correlations(rows, keys).join(S.quantile_spread(rows, keys), keys)
    out = both.groupBy(*_K).agg(*[F.max(F.when(F.col("split") == k, F.col(c))).alias(f"{k}_{n}") for k in ("train", "test") for c, n in (("spearman", "corr"), ("spread", "spread"))])
    p = F.col("train_corr") * F.col("test_corr")
    return out.withColumn("consistent", F.coalesce(p >= 0, F.lit(False)))


_VT = ["train_corr", "test_corr", "train_spread", "test_spread"]
_VTSQL = f"""{corr_sql('l', 'series_id, split, feature, horizon', 5)}, {spread_sql('l', 'series_id, split, feature, horizon')},
vt AS MATERIALIZED (SELECT series_id, feature, horizon, {', '.join(f"max(CASE WHEN split = '{k}' THEN {c} END) AS {k}_{n}" for k in ('train', 'test') for c, n in (('s', 'corr'), ('spread', 'spread')))} FROM cr JOIN sp USING (series_id, split, feature, horizon) GROUP BY ALL)"""
add("velocity_train_test", lambda s, d: tidy(velocity_splits(_velocity_pairs(s, d)), [*_K, "consistent"], _VT), f"{_VL}, {_VTSQL} SELECT series_id, feature, horizon, coalesce(train_corr * test_corr >= 0, false) AS consistent, {', '.join(f'{r6(c)} AS {c}' for c in _VT)} FROM vt")


def percent_score(x: str, part: list[str], higher_is_better: bool, direction: str = "reference") -> F.Column:
    """Percent rank times 100, nulls 50. In the reference's direction the best value gets the lowest score; 'intuitive' turns that round."""
    descending = higher_is_better if direction == "reference" else not higher_is_better
    return F.coalesce(W.percent_rank_average(x, part, descending), F.lit(0.5)) * 100


def velocity_scorecard(s: SparkSession, d: str, direction: str = "reference") -> DataFrame:
    # written once: correlations, spreads and changes would each build it from the given tables
    frame = stored(demo.structure(s, d).select("series_id", "date", "split", *dict.fromkeys([*VELOCITY.values(), *TRAIL.values()])), "structure")
    rows = S.pairs(frame, VELOCITY, TRAIL, ["series_id", "date", "split"])
    card = S.correlations(rows, _K).join(S.quantile_spread(rows, _K), _K).join(S.change_stats(frame, VELOCITY, ["series_id"]).drop("n"), ["series_id", "feature"])
    card = card.join(velocity_splits(rows).select(*_K, "consistent"), _K)
    card = card.withColumns({"abs_corr": F.round(F.abs("spearman"), 9), "abs_spread": F.round(F.abs("spread"), 9), "change_avg": F.round("change_avg", 9), "change_sd_pop": F.round("change_sd_pop", 9), "window": F.regexp_extract("feature", "_v(\\d+)$", 1).cast("int"), "grp": F.split("feature", "_")[0]})
    sc = lambda x, better: percent_score(x, ["series_id"], better, direction)
    card = card.withColumns({
        "stability": 0.55 * sc("change_avg", False) + 0.30 * sc("change_sd_pop", False) + 0.15 * sc("jumps", False),
        "information": 0.65 * sc("abs_corr", True) + 0.35 * sc("abs_spread", True),
        "reading": F.create_map(*[F.lit(x) for kv in ((2, 55.0), (4, 85.0), (8, 95.0), (12, 90.0), (26, 65.0)) for x in kv])[F.col("window")],
        "split_score": F.when(F.col("consistent"), 100.0).otherwise(0.0),
    })
    card = card.withColumn("total", 0.40 * F.col("information") + 0.25 * F.col("stability") + 0.25 * F.col("split_score") + 0.10 * F.col("reading"))
    long = card.filter("horizon in (4, 8)").groupBy("series_id", "grp", "window").agg(F.avg("total").alias("m"))
    best = long.groupBy("series_id", "grp").agg(F.min(F.struct((-F.round("m", 9)).alias("m"), "window")).alias("b")).select("series_id", "grp", F.col("b.window").alias("__w"))
    card = card.join(best, ["series_id", "grp"], "left").withColumn("recommended", F.col("window") == F.col("__w"))
    words = F.create_map(*[F.lit(x) for kv in ((2, "short-term window; higher noise risk"), (4, "short-term velocity candidate"), (8, "current swing velocity baseline"), (12, "medium swing velocity candidate"), (26, "medium-term window; slower response")) for x in kv])
    return card.withColumn("reason", F.concat_ws("; ", words[F.col("window")], F.when(F.col("consistent"), "train/test direction is consistent").otherwise("train/test direction is not consistent"), F.lit("historical structure research only")))


def pct_sql(x: str, part: str, descending: bool) -> str:
    return f"coalesce(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part}, {x} IS NULL ORDER BY {x} {'DESC' if descending else 'ASC'}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY {part}, {x} IS NULL) END, 0.5) * 100"


_CARD = f"""{_VL}, {_VTSQL}, {corr_sql('l', 'series_id, feature, horizon', 5, 'ca')}, {spread_sql('l', 'series_id, feature, horizon', 'sa')}, {_change_sql('structure', 'series_id', VELOCITY)},
w0 AS (SELECT series_id, feature, horizon, ca.s AS spearman, ca.p AS pearson, ca.n AS n, spread, round(change_avg, 9) AS change_avg, round(change_sd_pop, 9) AS change_sd_pop, jumps, coalesce(train_corr * test_corr >= 0, false) AS consistent, round(abs(ca.s), 9) AS abs_corr, round(abs(spread), 9) AS abs_spread, CAST(regexp_extract(feature, '_v(\\d+)$', 1) AS INTEGER) AS window_, split_part(feature, '_', 1) AS grp
FROM ca JOIN sa USING (series_id, feature, horizon) JOIN cs USING (series_id, feature) JOIN vt USING (series_id, feature, horizon)),
w1 AS (SELECT *, 0.55 * ({pct_sql('change_avg', 'series_id', False)}) + 0.30 * ({pct_sql('change_sd_pop', 'series_id', False)}) + 0.15 * ({pct_sql('jumps', 'series_id', False)}) AS stability,
0.65 * ({pct_sql('abs_corr', 'series_id', True)}) + 0.35 * ({pct_sql('abs_spread', 'series_id', True)}) AS information, CASE window_ WHEN 2 THEN 55.0 WHEN 4 THEN 85.0 WHEN 8 THEN 95.0 WHEN 12 THEN 90.0 ELSE 65.0 END AS reading, CASE WHEN consistent THEN 100.0 ELSE 0.0 END AS split_score FROM w0),
w2 AS MATERIALIZED (SELECT *, 0.40 * information + 0.25 * stability + 0.25 * split_score + 0.10 * reading AS total FROM w1),
w3 AS (SELECT series_id, grp, arg_min(window_, (-round(m, 9), window_)) AS bw FROM (SELECT series_id, grp, window_, avg(total) AS m FROM w2 WHERE horizon IN (4, 8) GROUP BY ALL) GROUP BY ALL),
card AS MATERIALIZED (SELECT w2.*, window_ = bw AS recommended FROM w2 LEFT JOIN w3 USING (series_id, grp))"""
_CD = ["spearman", "spread", "stability", "information", "total"]
_WORDS = "CASE window_ WHEN 2 THEN 'short-term window; higher noise risk' WHEN 4 THEN 'short-term velocity candidate' WHEN 8 THEN 'current swing velocity baseline' WHEN 12 THEN 'medium swing velocity candidate' ELSE 'medium-term window; slower response' END"
add("velocity_scorecard", lambda s, d: tidy(velocity_scorecard(s, d), [*_K, "recommended", "reason"], _CD, ["n"]),
    f"{_CARD} SELECT series_id, feature, horizon, recommended, concat_ws('; ', {_WORDS}, CASE WHEN consistent THEN 'train/test direction is consistent' ELSE 'train/test direction is not consistent' END, 'historical structure research only') AS reason, {', '.join(f'{r6(c)} AS {c}' for c in _CD)}, n FROM card")
add("strongest_window", lambda s, d: tidy(velocity_scorecard(s, d).groupBy("series_id", "window").agg(F.avg("abs_corr").alias("corr"), F.avg("information").alias("info"), F.avg("stability").alias("stab")), ["series_id", "window"], ["corr", "info", "stab"]),
    f"{_CARD} SELECT series_id, window_ AS window, {r6('avg(abs_corr)')} AS corr, {r6('avg(information)')} AS info, {r6('avg(stability)')} AS stab FROM card GROUP BY ALL")

# --- lead and lag -------------------------------------------------------------

LAGS = (-8, -4, -2, 0, 2, 4, 8)


def lead_lag_sql(source: str, features: dict[str, str], horizons: tuple[int, ...] = H) -> str:
    moved = {f"{n}@{k}": (f"lag({c}, {k})" if k >= 0 else f"lead({c}, {-k})") + " OVER (PARTITION BY series_id ORDER BY date)" for n, c in features.items() for k in LAGS}
    cols = ", ".join(f'{c} AS "{n}"' for n, c in moved.items())
    long = unpivot("ll0", "series_id", {n: f'"{n}"' for n in moved}, {h: f"r{h}" for h in horizons})
    return f"ll0 AS MATERIALIZED (SELECT series_id, date, {', '.join(f'r{h}' for h in horizons)}, {cols} FROM {source}), ll AS MATERIALIZED ({long}), {corr_sql('ll', 'series_id, feature, horizon', 5, 'lc')}"


def _lag_text(leads: str, follows: str, weak: str) -> str:
    return f"CASE WHEN s IS NULL OR abs(s) < 0.1 THEN '{weak}' ELSE (CASE WHEN lag > 0 THEN '{leads}_' || lag || 'w_' WHEN lag < 0 THEN '{follows}_' || (-lag) || 'w_' ELSE 'same_week_' END) || CASE WHEN s > 0 THEN 'positive' ELSE 'negative' END || '_historical_alignment' END"


_LIFE_F = {"pct": "mm_pct", "v4": "mm_pct_v4", "v8": "mm_pct_v8", "v12": "mm_pct_v12", "v26": "mm_pct_v26", "accel8": "mm_accel8"}
_STRUCT_F = {f"{g}_{n}": f"{g}_pct{c}" for g in GROUPS for n, c in (("pct", ""), ("v4", "_v4"), ("v8", "_v8"))}
_LLCOLS = f"SELECT series_id, split_part(feature, '@', 1) AS feature, horizon, CAST(split_part(feature, '@', 2) AS INTEGER) AS lag, n, p, s FROM lc"


def _lead_lag(frame: Callable, features: dict[str, str], words: dict[str, str], horizons: tuple[int, ...] = H) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        out = S.lead_lag(frame(s, d), features, {h: f"r{h}" for h in horizons}, LAGS, ["series_id"])
        return tidy(out.withColumn("text", C.lead_lag_text("lag", "spearman", **words)), [*_K, "lag", "text"], ["pearson", "spearman"], ["n"])

    return run


_LL = f"SELECT series_id, feature, horizon, lag, {{text}} AS text, {r6('p')} AS pearson, {r6('s')} AS spearman, n FROM ({_LLCOLS})"
_WORDS1 = {"leads": "mm_feature_leads_gold", "follows": "gold_or_later_mm_alignment", "weak": "weak_or_no_clear_historical_relationship"}
add("lead_lag_lifecycle", _lead_lag(demo.lifecycle, _LIFE_F, _WORDS1), f"{LIFE}, {lead_lag_sql('life', _LIFE_F)} {_LL.format(text=_lag_text(**_WORDS1))}")
add("lead_lag_structure", _lead_lag(demo.structure, _STRUCT_F, C.STRUCTURE_WORDS), f"{STRUCT}, {lead_lag_sql('structure', _STRUCT_F)} {_LL.format(text=_lag_text(**C.STRUCTURE_WORDS))}")


def _recommended(s: SparkSession, d: str) -> DataFrame:
    """Lead-lag of the velocity window that each series and group's scorecard recommends."""
    best = velocity_scorecard(s, d).filter("recommended").select("series_id", "feature").distinct()
    out = S.lead_lag(demo.structure(s, d), VELOCITY, {h: f"r{h}" for h in (4, 8)}, LAGS, ["series_id"])
    return tidy(out.join(best, ["series_id", "feature"], "left_semi"), [*_K, "lag"], ["pearson", "spearman"], ["n"])


add("lead_lag_recommended", _recommended, f"{_CARD}, {lead_lag_sql('structure', VELOCITY, (4, 8))} SELECT series_id, feature, horizon, lag, {r6('p')} AS pearson, {r6('s')} AS spearman, n FROM ({_LLCOLS}) WHERE (series_id, feature) IN (SELECT (series_id, feature) FROM card WHERE recommended)")


def _strongest_lead_lag(s: SparkSession, d: str) -> DataFrame:
    out = S.lead_lag(demo.lifecycle(s, d), _LIFE_F, TRAIL, LAGS, ["series_id"]).filter("lag > 0 and spearman is not null").withColumn("a", F.round(F.abs("spearman"), 9))
    w = F.row_number().over(W.Window.partitionBy("series_id").orderBy(F.desc("a"), "feature", "horizon", "lag"))
    return tidy(out.withColumn("rank", w).filter("rank <= 5"), [*_K, "lag", "rank"], ["spearman"])


add("strongest_lead_lag", _strongest_lead_lag, f"{LIFE}, {lead_lag_sql('life', _LIFE_F)} SELECT series_id, feature, horizon, lag, CAST(rank AS INTEGER) AS rank, {r6('s')} AS spearman FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(abs(s), 9) DESC, feature, horizon, lag) AS rank FROM ({_LLCOLS}) WHERE lag > 0 AND s IS NOT NULL) WHERE rank <= 5")
