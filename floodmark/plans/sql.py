"""The demo views as SQL, for the comparison with another engine."""

from __future__ import annotations

REGIONS = "SELECT n_nationkey, r_name AS series_id FROM nation JOIN region ON n_regionkey = r_regionkey"

POSITIONS = f"""positions AS (
SELECT series_id, CAST(date_trunc('week', l_shipdate) AS DATE) + 1 AS date,
  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0.0 END) AS mm_long, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END) AS mm_short,
  sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0.0 END) AS producer_long, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0.0 END) AS producer_short,
  sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity ELSE 0.0 END) AS swap_long, sum(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_quantity ELSE 0.0 END) AS swap_short,
  sum(l_quantity) AS oi
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN ({REGIONS}) ON s_nationkey = n_nationkey
WHERE CAST(date_trunc('week', l_shipdate) AS DATE) + 1 <= DATE '2001-07-31' GROUP BY ALL)"""

PRICES = f"""prices AS (
SELECT series_id, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
FROM orders JOIN customer ON o_custkey = c_custkey JOIN ({REGIONS}) ON c_nationkey = n_nationkey GROUP BY ALL)"""

ALT_PRICES = f"""alt_prices AS (
SELECT series_id, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS alt_close
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN ({REGIONS}) ON s_nationkey = n_nationkey GROUP BY ALL)"""

MASTER = """master AS MATERIALIZED (
SELECT p.*, mm_long - mm_short AS mm_net, producer_long - producer_short AS producer_net, swap_long - swap_short AS swap_net, r.close, r.date AS asof_date
FROM positions p ASOF JOIN prices r ON p.series_id = r.series_id AND p.date >= r.date)"""

W = "PARTITION BY series_id ORDER BY date"


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER ({W})" if k >= 0 else f"lead({x}, {-k}) OVER ({W})"


def frame(agg: str, a: str, b: str) -> str:
    return f"{agg} OVER ({W} ROWS BETWEEN {a} AND {b})"


def r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def solid(x: str, a: str, b: str) -> str:
    return f"list_filter({frame(f'list({x})', a, b)}, lambda v: v IS NOT NULL)"


def percentile(x: str, n: int, least: int) -> str:
    a = solid(x, f"{n - 1} PRECEDING", "CURRENT ROW")
    return f"CASE WHEN len({a}) >= {least} THEN len(list_filter({a}, lambda v: v <= {a}[-1])) / CAST(len({a}) AS DOUBLE) END"


def prior_percentile(x: str, n: int, least: int) -> str:
    a = f"coalesce({solid(x, f'{n} PRECEDING', '1 PRECEDING')}, [])"
    return f"CASE WHEN {x} IS NOT NULL AND len({a}) >= {least} THEN len(list_filter({a}, lambda v: v <= {x})) / CAST(len({a}) AS DOUBLE) END"


def zscore(x: str, n: int, least: int, prior: bool = False) -> str:
    a, b = (f"{n} PRECEDING", "1 PRECEDING") if prior else (f"{n - 1} PRECEDING", "CURRENT ROW")
    sd = frame(f"stddev_samp({x})", a, b)
    return f"CASE WHEN {frame(f'count({x})', a, b)} >= {least} AND {sd} > 1e-12 THEN round(({x} - {frame(f'avg({x})', a, b)}) / {sd}, 12) END"


def trailing(x: str, k: int) -> str:
    return f"{x} / nullif({lag(x, k)}, 0) - 1"


def forward(x: str, k: int) -> str:
    return f"{lag(x, -k)} / nullif({x}, 0) - 1"


REGIME = f"""CASE WHEN {frame('count(close)', '51 PRECEDING', 'CURRENT ROW')} < 26 OR {trailing('close', 26)} IS NULL THEN 'unclassified'
 WHEN close > {frame('avg(close)', '51 PRECEDING', 'CURRENT ROW')} AND {trailing('close', 26)} > 0.05 THEN 'bull'
 WHEN close < {frame('avg(close)', '51 PRECEDING', 'CURRENT ROW')} AND {trailing('close', 26)} < -0.05 THEN 'bear' ELSE 'range' END"""
SPLIT = "CASE WHEN date <= DATE '1998-12-31' THEN 'train' ELSE 'test' END"

_PCT = ", ".join(f"{percentile(c, 156, 52)} AS {k}_pct" for k, c in (("mm", "mm_net"), ("producer", "producer_net"), ("swap", "swap_net"), ("oi", "oi"), ("close", "close")))
_RET = ", ".join([f"{trailing('close', k)} AS r{k}" for k in (1, 2, 4, 8)] + [f"{forward('close', k)} AS f{k}" for k in (1, 2, 4, 8)])
WEEKLY = f"""weekly0 AS MATERIALIZED (SELECT *, {_RET}, {_PCT}, {SPLIT} AS split, {REGIME} AS regime FROM master),
weekly AS MATERIALIZED (SELECT *, {zscore('r1', 52, 26)} AS r1_z, {zscore('mm_net', 156, 52)} AS mm_z, {zscore('oi', 156, 52)} AS oi_z, {zscore('close', 156, 52)} AS close_z FROM weekly0)"""

BASE = f"WITH {POSITIONS},\n{PRICES},\n{MASTER}"
FULL = f"{BASE},\n{WEEKLY}"

_SIDES = ("long", "short", "net")
STRUCTURE = f"""structure0 AS MATERIALIZED (SELECT *, {", ".join(f"{trailing('close', k)} AS r{k}" for k in (1, 2, 4, 8))}, {", ".join(f"{prior_percentile(f'mm_{s}', 156, 20)} AS {s}_pct" for s in _SIDES)}, {SPLIT} AS split FROM master),
structure1 AS MATERIALIZED (SELECT *, {", ".join(f"{s}_pct - {lag(f'{s}_pct', k)} AS {s}_pct_v{k}" for s in _SIDES for k in (2, 4, 8, 12, 26))}, {", ".join(f"mm_{s} - {lag(f'mm_{s}', 8)} AS {s}_change8" for s in _SIDES)} FROM structure0),
structure AS MATERIALIZED (SELECT *, CASE WHEN long_pct IS NULL OR short_pct IS NULL OR net_pct IS NULL OR long_pct_v8 IS NULL OR short_pct_v8 IS NULL OR net_pct_v8 IS NULL THEN 'MM_STRUCTURE_NEUTRAL'
 WHEN long_pct >= 0.8 AND net_pct >= 0.8 THEN 'MM_STRUCTURE_CROWDED_LONG' WHEN long_pct < 0.4 AND short_pct < 0.4 THEN 'MM_STRUCTURE_LOW_PARTICIPATION'
 WHEN long_pct_v8 > 0 AND short_pct_v8 <= 0 AND net_pct_v8 > 0 THEN 'MM_STRUCTURE_ACCUMULATION' WHEN short_pct_v8 < 0 AND net_pct_v8 > 0 THEN 'MM_STRUCTURE_SHORT_COVERING_RALLY'
 WHEN long_pct_v8 < 0 AND net_pct_v8 < 0 THEN 'MM_STRUCTURE_LONG_LIQUIDATION' WHEN short_pct_v8 > 0 AND net_pct_v8 < 0 THEN 'MM_STRUCTURE_SHORT_BUILDING' ELSE 'MM_STRUCTURE_NEUTRAL' END AS structure_state,
 CASE WHEN long_change8 IS NULL OR short_change8 IS NULL THEN 'NEUTRAL_STRUCTURE'
 WHEN long_change8 > 0 AND short_change8 > 0 THEN 'MIXED_LONG_AND_SHORT_UP' WHEN long_change8 < 0 AND short_change8 < 0 THEN 'MIXED_LONG_AND_SHORT_DOWN'
 WHEN long_change8 > 0 AND short_change8 < 0 AND abs(long_change8) >= abs(short_change8) THEN 'LONG_BUILDING' WHEN long_change8 > 0 AND short_change8 < 0 THEN 'SHORT_COVERING'
 WHEN long_change8 < 0 AND short_change8 > 0 AND abs(long_change8) >= abs(short_change8) THEN 'LONG_LIQUIDATION' WHEN long_change8 < 0 AND short_change8 > 0 THEN 'SHORT_BUILDING'
 WHEN long_change8 > 0 THEN 'LONG_BUILDING' WHEN short_change8 < 0 THEN 'SHORT_COVERING' WHEN long_change8 < 0 THEN 'LONG_LIQUIDATION' WHEN short_change8 > 0 THEN 'SHORT_BUILDING' ELSE 'NEUTRAL_STRUCTURE' END AS contribution_state FROM structure1)"""
STRUCT = f"{BASE},\n{STRUCTURE}"

LIFECYCLE = f"""life0 AS MATERIALIZED (SELECT *, {", ".join(f"mm_pct - {lag('mm_pct', k)} AS mm_pct_v{k}" for k in (4, 8, 12, 26))} FROM weekly),
life AS MATERIALIZED (SELECT *, mm_pct_v8 - {lag('mm_pct_v8', 8)} AS mm_accel8, CASE WHEN mm_pct IS NULL OR mm_pct_v8 IS NULL THEN 'MM_NEUTRAL' WHEN mm_pct < 0.3 AND mm_pct_v8 < 0 THEN 'MM_RESET'
 WHEN mm_pct < 0.4 AND mm_pct_v8 > 0 THEN 'MM_ACCUMULATION' WHEN mm_pct >= 0.8 AND mm_pct_v8 > 0 THEN 'MM_CROWDED_EXPANSION' WHEN mm_pct >= 0.4 AND mm_pct_v8 > 0 THEN 'MM_EXPANSION'
 WHEN mm_pct_v8 < 0 THEN 'MM_DISTRIBUTION' ELSE 'MM_NEUTRAL' END AS lifecycle_state FROM life0)"""
LIFE = f"{FULL},\n{LIFECYCLE}"

FACTORS = ("mm_net", "producer_net", "oi")


def full_rank(x: str, part: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY {part}, {x} IS NULL) END"


DEFINITIONS = "defs AS MATERIALIZED (SELECT *, " + ", ".join(
    [f"{trailing('close', k)} AS r{k}" for k in (1, 2, 4, 8)] + [f"{forward('close', k)} AS f{k}" for k in (1, 2, 4, 8)]
    + [f"{prior_percentile(f, n, 52)} AS {f}__p{n}" for f in FACTORS for n in (52, 104, 156)]
    + [f"{zscore(f, n, 52, True)} AS {f}__z{n}" for f in FACTORS for n in (52, 156)]
    + [f"{full_rank(f, 'series_id')} AS {f}__full" for f in FACTORS] + [f"{SPLIT} AS split"]
) + " FROM master)"
DEFS = f"{BASE},\n{DEFINITIONS}"


def bars(unit: str) -> str:
    at = "date_trunc('hour', ts) AS bar_start" if unit == "hour" else "CAST(ts AS DATE) AS date"
    return f"SELECT event_type AS series_id, {at}, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL"
