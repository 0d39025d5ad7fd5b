"""Numbers, buckets and states as column expressions; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: ColumnOrName) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def number(c: ColumnOrName) -> Column:
    """Text to a finite double, anything else to null."""
    x = F.expr(f"try_cast(trim({c}) as double)") if isinstance(c, str) else F.try_to_number(c, F.lit("999999999999.999999")).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def mixed_date(c: ColumnOrName) -> Column:
    """Six digits as yyMMdd, else the usual spellings; null if none fits."""
    x = F.trim(col(c))
    six = F.try_to_timestamp(x, F.lit("yyMMdd")).cast("date")
    six = F.when(F.year(six) > 2068, F.add_months(six, -1200)).otherwise(six)  # 69 to 99 are of the last century
    other = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "MM_dd_yyyy", "yyyyMMdd")])
    return F.when(x.rlike("^[0-9]{6}$"), six).otherwise(other.cast("date"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def points(c: ColumnOrName, bound: str = "unit") -> Column:
    """0..1 to 0..100, points stay. bound 'unit': values in [0, 1] are shares; 'abs': values with |x| <= 1."""
    x = col(c)
    share = (x >= 0) & (x <= 1) if bound == "unit" else F.abs(x) <= 1
    return F.when(share, x * 100).otherwise(x)


def decile_closed_right(c: ColumnOrName) -> Column:
    """1..10, edges belong to the lower bucket, 0 to the first; values outside 0..1 are clipped."""
    x = F.least(F.greatest(col(c), F.lit(0.0)), F.lit(1.0))
    out = F.when(col(c).isNull(), None)
    for k, edge in enumerate((0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 1):
        out = out.when(x <= edge, k)
    return out.otherwise(10)


def decile_floor(c: ColumnOrName) -> Column:
    """1..10, edges belong to the higher bucket, 1 to the last."""
    return F.when(col(c).isNotNull(), F.least(F.floor(col(c) * 10), F.lit(9)).cast("int") + 1)


#: Left-closed edges of velocity buckets, in points.
VELOCITY_EDGES = (-30, -10, 0, 10, 30)


def velocity_bucket(c: ColumnOrName) -> Column:
    """1..6 by VELOCITY_EDGES; the argument is a share."""
    x = col(c) * 100
    out = F.when(x.isNull(), None)
    for k, edge in enumerate(VELOCITY_EDGES, 1):
        out = out.when(x < edge, k)
    return out.otherwise(6)


def rank_decile(r: Column, n: Column) -> Column:
    """Bucket 1..10 of row number r among n, as quantile edges over 1..n deal them."""
    return F.greatest(F.lit(0), F.floor(((r - 1) * 10 + n - 2) / F.greatest(n - 1, F.lit(1))) - 1).cast("int") + 1


def lifecycle_state(pct: ColumnOrName, velocity: ColumnOrName) -> Column:
    p, v = col(pct), col(velocity)
    return (
        F.when(p.isNull() | v.isNull(), "MM_NEUTRAL")
        .when((p < 0.3) & (v < 0), "MM_RESET")
        .when((p < 0.4) & (v > 0), "MM_ACCUMULATION")
        .when((p >= 0.8) & (v > 0), "MM_CROWDED_EXPANSION")
        .when((p >= 0.4) & (v > 0), "MM_EXPANSION")
        .when(v < 0, "MM_DISTRIBUTION")
        .otherwise("MM_NEUTRAL")
    )


LIFECYCLE_STATES = ("MM_RESET", "MM_ACCUMULATION", "MM_EXPANSION", "MM_CROWDED_EXPANSION", "MM_DISTRIBUTION", "MM_NEUTRAL")


def contribution_state(long_change: ColumnOrName, short_change: ColumnOrName) -> Column:
    """Which side moved the net position, and which way."""
    a, b = col(long_change), col(short_change)
    up, down = F.abs(a) >= F.abs(b), F.abs(a) < F.abs(b)
    return (
        F.when(a.isNull() | b.isNull() | ((a == 0) & (b == 0)), "NEUTRAL_STRUCTURE")
        .when((a > 0) & (b > 0), "MIXED_LONG_AND_SHORT_UP")
        .when((a < 0) & (b < 0), "MIXED_LONG_AND_SHORT_DOWN")
        .when((a >= 0) & (b <= 0) & up, "LONG_BUILDING")
        .when((a >= 0) & (b <= 0) & down, "SHORT_COVERING")
        .when((a <= 0) & (b >= 0) & up, "LONG_LIQUIDATION")
        .otherwise("SHORT_BUILDING")
    )


CONTRIBUTION_STATES = ("LONG_BUILDING", "SHORT_COVERING", "LONG_LIQUIDATION", "SHORT_BUILDING", "MIXED_LONG_AND_SHORT_UP", "MIXED_LONG_AND_SHORT_DOWN", "NEUTRAL_STRUCTURE")


def structure_state(long_pct: str, short_pct: str, net_pct: str, long_v: str, short_v: str, net_v: str) -> Column:
    lp, sp, np_, lv, sv, nv = map(col, (long_pct, short_pct, net_pct, long_v, short_v, net_v))
    rules = [
        (lp.isNull() | sp.isNull() | np_.isNull() | lv.isNull() | sv.isNull() | nv.isNull(), "NEUTRAL"),
        ((lp >= 0.8) & (np_ >= 0.8), "CROWDED_LONG"),
        ((lp < 0.4) & (sp < 0.4), "LOW_PARTICIPATION"),
        ((lv > 0) & (sv <= 0) & (nv > 0), "ACCUMULATION"),
        ((sv < 0) & (nv > 0), "SHORT_COVERING_RALLY"),
        ((lv < 0) & (nv < 0), "LONG_LIQUIDATION"),
        ((sv > 0) & (nv < 0), "SHORT_BUILDING"),
        (F.lit(True), "NEUTRAL"),
    ]
    return F.coalesce(*[F.when(c, "MM_STRUCTURE_" + name) for c, name in rules])


STRUCTURE_STATES = tuple("MM_STRUCTURE_" + x for x in ("ACCUMULATION", "SHORT_COVERING_RALLY", "CROWDED_LONG", "LONG_LIQUIDATION", "SHORT_BUILDING", "LOW_PARTICIPATION", "NEUTRAL"))


def weekly_change_state(long_change: ColumnOrName, short_change: ColumnOrName, net_change: ColumnOrName) -> Column:
    a, b, n = col(long_change), col(short_change), col(net_change)
    long_ = F.when(a > 0, "LONG_BUILDING").when(a < 0, "LONG_LIQUIDATION")
    short = F.when(b > 0, "SHORT_BUILDING").when(b < 0, "SHORT_COVERING")
    net = F.when(n > 0, "NET_UP").when(n < 0, "NET_DOWN").otherwise("NEUTRAL")
    return F.when(long_.isNotNull() & short.isNotNull(), F.concat_ws("_", long_, short)).otherwise(net)


NEAR_ZERO = 0.03


def alignment(base: ColumnOrName, other: ColumnOrName) -> Column:
    a, b = col(base), col(other)
    return (
        F.when(a.isNull() | b.isNull(), "MIXED_OR_UNCLEAR")
        .when((F.abs(a) < NEAR_ZERO) & (F.abs(b) < NEAR_ZERO), "BOTH_NEAR_ZERO")
        .when((a > 0) & (b > 0), "SAME_DIRECTION_POSITIVE")
        .when((a < 0) & (b < 0), "SAME_DIRECTION_NEGATIVE")
        .when((a > 0) & (b < 0), "BASELINE_POSITIVE_CANDIDATE_NEGATIVE")
        .when((a < 0) & (b > 0), "BASELINE_NEGATIVE_CANDIDATE_POSITIVE")
        .otherwise("MIXED_OR_UNCLEAR")
    )


def velocity_reading(long8: ColumnOrName, long26: ColumnOrName, fast: ColumnOrName, net8: ColumnOrName, net26: ColumnOrName) -> Column:
    l8, l26, f, n8, n26 = map(col, (long8, long26, fast, net8, net26))
    still = (F.abs(l26) < NEAR_ZERO) & (F.abs(n26) < NEAR_ZERO)
    return (
        F.when(l8.isNull() | l26.isNull() | f.isNull() | n8.isNull() | n26.isNull(), "MIXED_STRUCTURE")
        .when((l26 > 0) & (n26 > 0), "MEDIUM_TERM_PARTICIPATION_BUILDING")
        .when((l26 < 0) & (n26 < 0), "MEDIUM_TERM_STRUCTURE_WEAKENING")
        .when((F.abs(f) >= NEAR_ZERO) & still, "SHORT_TERM_ONLY_REACTION")
        .when(((l8 > 0) | (n8 > 0)) & ((l26 <= 0) | (n26 <= 0)), "SHORT_TERM_RECOVERY_MEDIUM_TERM_UNCONFIRMED")
        .otherwise("MIXED_STRUCTURE")
    )


def steps(x: Column, edges: tuple[float, ...], names: tuple[str, ...], missing: str) -> Column:
    """The name of the left-closed step that x is in."""
    out = F.when(x.isNull(), missing)
    for edge, name in zip(edges, names, strict=False):
        out = out.when(x < edge, name)
    return out.otherwise(names[-1])


def percentile_state(pct: ColumnOrName) -> Column:
    return steps(points(pct), (20, 40, 60, 80), ("MM_EXTREME_LOW", "MM_LOW", "MM_NEUTRAL", "MM_HIGH", "MM_EXTREME_HIGH"), "N/A")


def percentile_level(pct: ColumnOrName) -> Column:
    return steps(points(pct), (10, 20, 40, 60, 80, 90), ("極低", "偏低到極低", "偏低", "中性", "偏高", "高", "極高"), "N/A")


def market_state(mm: ColumnOrName, oi: ColumnOrName, strict: bool = False) -> Column:
    """Positioning by open interest. The strict form takes points and other words, and no nulls."""
    m, o = (col(mm), col(oi)) if strict else (points(mm, "abs"), points(oi, "abs"))
    high = "Healthy Bullish Positioning" if strict else "Healthy High Positioning"
    full = F.when(o >= 60, "Expansion / Momentum").otherwise("Euphoria / Thin Momentum")
    low = steps(m, (20, 40, 60), ("Extreme Low / Potential Reset", "Accumulation / Weak Positioning", "Neutral / Transition", high), "N/A")
    return F.when(m >= 80, full).otherwise(low)


def tendency(avg1: ColumnOrName, avg2: ColumnOrName, avg4: ColumnOrName, avg8: ColumnOrName, win8: ColumnOrName) -> Column:
    """What followed similar states. The rule for high_risk comes after a wider one, so it never applies."""
    a1, a2, a4, a8, w = map(col, (avg1, avg2, avg4, avg8, win8))
    return (
        F.when(a1.isNull() | a2.isNull() | a4.isNull() | a8.isNull() | w.isNull(), "na")
        .when((a1 < 0) & (a4 < 0) & (a8 < 0) & (w < 0.45), "risk_off_caution")
        .when((a1 < 0) & (a2 < 0) & (a4 < 0) & (a8 < 0) & (w < 0.35), "high_risk")
        .when((a1 > 0) & (a4 > 0) & (a8 > 0) & (w >= 0.55), "tailwind")
        .otherwise("mixed")
    )


def sample_tendency(median8: ColumnOrName, win8: ColumnOrName) -> Column:
    m, w = col(median8), col(win8)
    return F.when((m > 0) & (w >= 0.55), "historical_sample_positive").when((m < 0) & (w <= 0.45), "historical_sample_negative").otherwise("historical_sample_mixed")


def confidence(cases: ColumnOrName, win8: ColumnOrName, median8: ColumnOrName, avg8: ColumnOrName, score: ColumnOrName) -> Column:
    n, w, m, a, s = map(col, (cases, win8, median8, avg8, score))
    steady = (n >= 20) & (((m > 0) & (a > 0)) | ((m < 0) & (a < 0)))
    return F.when(steady & ((w >= 0.75) | (w <= 0.25)) & (s >= 85), "High").when(steady & ((w >= 0.65) | (w <= 0.35)), "Medium").otherwise("Low")


def anomaly_reason(date: ColumnOrName, close: ColumnOrName, ret: ColumnOrName, ret_z: ColumnOrName, close_z: ColumnOrName, since: int = 2025, levels: tuple[float, float] = (4000, 5000)) -> Column:
    c, r, rz, cz = map(col, (close, ret, ret_z, close_z))
    rules = [(c >= x, f"level>={x:g}") for x in levels]
    rules += [(F.abs(r) >= 0.05, "abs_1w_return>=5pct"), (F.abs(rz) >= 2.5, "abs_return_zscore_52w>=2.5"), (cz >= 2.5, "level_zscore_156w>=2.5")]
    return F.when(F.year(col(date)) >= since, F.concat_ws("; ", *[F.when(cond, text) for cond, text in rules])).otherwise("")


def sample_split(date: ColumnOrName, train_end: str = "2018-12-31", test_start: str = "2019-01-01", start: str | None = None) -> Column:
    d = col(date)
    train = d <= F.lit(train_end).cast("date")
    if start:
        train = train & (d >= F.lit(start).cast("date"))
    return F.when(train, "train").when(d >= F.lit(test_start).cast("date"), "test").otherwise("out_of_scope")


def source_class(c: ColumnOrName) -> Column:
    low = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.when(low == "", "Missing").when(low.contains("fred"), "FRED").when(low.contains("yahoo"), "Yahoo").when(low.contains("stooq"), "Stooq").otherwise("Other")


def true_text(c: ColumnOrName) -> Column:
    return F.lower(F.trim(F.coalesce(col(c), F.lit("")))).isin("true", "1", "yes", "y")


def lead_lag_text(lag: ColumnOrName, corr: ColumnOrName, leads: str = "mm_feature_leads_gold", follows: str = "gold_or_later_mm_alignment", weak: str = "weak_or_no_clear_historical_relationship") -> Column:
    k, c = col(lag), col(corr)
    way = F.concat(F.when(c > 0, "positive").otherwise("negative"), F.lit("_historical_alignment"))
    head = F.when(k > 0, F.concat(F.lit(leads + "_"), k, F.lit("w_"))).when(k < 0, F.concat(F.lit(follows + "_"), -k, F.lit("w_"))).otherwise("same_week_")
    return F.when(c.isNull() | (F.abs(c) < 0.1), weak).otherwise(F.concat(head, way))


STRUCTURE_WORDS = {"leads": "mm_structure_feature_leads_gold", "follows": "mm_structure_feature_lags_or_confirms_gold", "weak": "weak_historical_structure_relationship"}


def predictive_grade(corr: ColumnOrName, spread: ColumnOrName, obvious: ColumnOrName) -> Column:
    """strong, medium, weak or none."""
    c, s, n = F.round(F.coalesce(F.abs(col(corr)), F.lit(0.0)), 9), F.coalesce(F.abs(col(spread)), F.lit(0.0)), col(obvious)
    return F.when((c >= 0.6) & (s >= 0.008), "strong").when((c >= 0.3) & (s >= 0.005), "medium").when((n >= 2) & (s >= 0.003), "weak").otherwise("none")


def next_week_start(date: ColumnOrName) -> Column:
    """The Monday after the week of date."""
    return F.date_add(F.date_trunc("week", col(date)).cast("date"), 7)


def months_before(date: ColumnOrName, n: int) -> Column:
    return F.add_months(col(date), -n)


def escape_formula(c: ColumnOrName) -> Column:
    """Text that a spreadsheet would run gets a quote before it."""
    return F.when(col(c).rlike("^[=+@]"), F.concat(F.lit("'"), col(c))).otherwise(col(c))


def path_json(c: ColumnOrName) -> Column:
    return F.to_json(F.transform(col(c), lambda x: F.round(x * 100, 4)))
