"""Queries of sources, cleaning, joins, weekly outcomes, quality and streams, with SQL where one can be given."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean as K
from ..operators import joins as J
from ..operators import outcomes as O
from ..operators import quality as Q
from ..sources import readers as R
from ..sources import sinks
from ..sources.paths import scratch, stored
from ..streaming import bars as B
from . import demo, sql, weekly
from .search import FEATURES, TEND, tendencies
from .sql import ALT_PRICES, BASE, FULL, POSITIONS, PRICES, r6
from .studies import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF, BEFORE = "2024-01-24 12:00:00", "2024-01-17 12:00:00"
KEY = ["series_id", "date"]


def add(name: str, run: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


# --- sources and sinks: the demo views, landed as files and read back ----------

_HEAD = {"series_id": " Market_and_Exchange_Names", "date": "Report_Date_as_YYYY-MM-DD", "oi": "Open_Interest_All", "mm_long": "m_money positions long_all", "mm_short": "M_Money_Positions_Short_All",
         "producer_long": "Prod_Merc_Positions_Long_All", "producer_short": "Prod_Merc_Positions_Short_All", "swap_long": "Swap_Positions_Long_All", "swap_short": "Swap__Positions_Short_All"}
_COLS = list(_HEAD)
_POS = f"WITH {POSITIONS} SELECT series_id, date, {', '.join(f'{r6(c)} AS {c}' for c in _COLS[2:])} FROM positions"


def _landed(s: SparkSession, d: str, header: bool) -> str:
    path = scratch(s, "report")
    odd = F.when(F.pmod(F.dayofyear("date"), F.lit(2)) == 0, F.date_format("date", "yyMMdd")).otherwise(F.col("date").cast("string"))
    out = demo.positions(s, d).withColumn("date", odd).select(*[F.col(c).alias(h) for c, h in _HEAD.items()])
    if not header:
        out = out.withColumn("FutOnly_or_Combined", F.lit("FutOnly"))
    out.write.option("header", header).option("encoding", "ISO-8859-1").csv(path)
    return path


add("src_positions_csv", lambda s, d: tidy(R.read_positions(s, _landed(s, d, True)), KEY, _COLS[2:]), _POS)
add("src_headerless_csv", lambda s, d: tidy(R.read_headerless(s, _landed(s, d, False), [*_HEAD.values(), "FutOnly_or_Combined"]), KEY, _COLS[2:]), _POS)


def _closes(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "closes")
    out = demo.prices(s, d).select("series_id", F.date_format("date", "MM/dd/yyyy").alias("Date"), F.when(F.dayofmonth("date") == 1, ".").otherwise(F.col("close").cast("string")).alias("Close"), F.lit("Vendor GC feed").alias("Source"))
    out.write.option("header", True).csv(path)
    return R.read_closes(s, path, "gc feed")


add("src_close_csv", lambda s, d: tidy(_closes(s, d), KEY, ["close"]), f"WITH {PRICES} SELECT series_id, date, {r6('CASE WHEN day(date) <> 1 THEN close END')} AS close FROM prices")
_OHLC = ["open", "high", "low", "close", "volume"]


def _ohlc(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "ohlc")
    bad = F.when(F.dayofmonth("date") == 2, "n/a").otherwise(F.col("low").cast("string"))
    demo.prices(s, d).select("series_id", "date", "open", "high", bad.alias("low"), "close", "volume", F.lit(None).cast("string").alias("source")).write.option("header", True).csv(path)
    return R.read_ohlc(s, path, "demo")


add("src_ohlc_csv", lambda s, d: tidy(_ohlc(s, d), [*KEY, "source"], _OHLC), f"WITH {PRICES} SELECT series_id, date, 'demo' AS source, {', '.join(f'{r6(c)} AS {c}' for c in _OHLC)} FROM prices WHERE day(date) <> 2")


def _chart(s: SparkSession, d: str) -> DataFrame:
    """Bars as vendor documents, one for each series and month, and back."""
    b = demo.prices(s, d)
    rows = b.groupBy("series_id", F.trunc("date", "month").alias("m")).agg(F.array_sort(F.collect_list(F.struct(F.unix_timestamp(F.col("date").cast("timestamp")).alias("t"), *_OHLC))).alias("r"))
    col = lambda c: F.transform("r", lambda x: x[c])
    quote = F.struct(*[col(c).alias(c) for c in _OHLC])
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.col("series_id").alias("symbol"), F.lit("America/New_York").alias("exchangeTimezoneName")).alias("meta"), col("t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart")))
    path = scratch(s, "chart")
    rows.select(doc.alias("value")).write.text(path)
    return R.parse_chart_json(s.read.text(path), "value").select(F.col("symbol").alias("series_id"), F.to_date("ts").alias("date"), "position", *_OHLC)


add("src_chart_json", lambda s, d: tidy(_chart(s, d), [*KEY, "position"], _OHLC), f"WITH {PRICES} SELECT series_id, date, CAST(row_number() OVER (PARTITION BY series_id, date_trunc('month', date) ORDER BY date) - 1 AS INTEGER) AS position, {', '.join(f'{r6(c)} AS {c}' for c in _OHLC)} FROM prices")


def _weekly_file(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "weekly")
    sinks.write_table(demo.master(s, d).select("series_id", "date", "close", "mm_net").withColumn("close", F.col("close").cast("string")), path, form="csv")
    df = R.load_weekly(s.read.csv(path, header=True), ["series_id", "date", "close", "mm_net"], ["date", "close"])
    return df.withColumn("split", C.sample_split("date", demo.TRAIN_END, demo.TEST_START))


add("src_weekly_master", lambda s, d: tidy(_weekly_file(s, d), [*KEY, "split"], ["close", "mm_net"]), f"{BASE} SELECT series_id, date, {sql.SPLIT} AS split, {r6('close')} AS close, {r6('mm_net')} AS mm_net FROM master")


def _calendar(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A calendar whose dates follow from the bars: the first Monday of trading and the third are holidays, the week after has an override."""
    first = demo.bars(s, d, "day").agg(F.min(F.date_trunc("week", "date").cast("date")).alias("m"))
    text = lambda k: F.date_add("m", k).cast("string")
    doc = first.select(
        F.array(text(0)).alias("no_daily_bar_dates"), F.array(F.struct(text(14).alias("date"), F.lit(False).alias("daily_bar_expected"), F.lit("https://example.org").alias("source_url"))).alias("holidays"),
        F.create_map(text(21), F.struct(F.array(text(21), text(22)).alias("expected_daily_dates"), F.lit(46).alias("expected_hourly_bars"), F.lit(True).alias("holiday_affected"))).alias("weekly_overrides"),
    )
    path = scratch(s, "calendar")
    doc.coalesce(1).write.json(path)
    return R.read_calendar(s, path)


_DAILY = f"daily AS MATERIALIZED ({sql.bars('day')})"
_FIRST = "(SELECT min(CAST(date_trunc('week', ts) AS DATE)) AS m FROM events)"
add("src_calendar_json", lambda s, d: _calendar(s, d)[0].select("date", F.lit("excluded").alias("kind"), F.lit(0).alias("n")).unionByName(_calendar(s, d)[1].select(F.col("week_start").alias("date"), F.lit("override").alias("kind"), F.size("expected_daily_dates").alias("n"))),
    f"SELECT m AS date, 'excluded' AS kind, 0 AS n FROM {_FIRST} UNION ALL SELECT m + 14, 'excluded', 0 FROM {_FIRST} UNION ALL SELECT m + 21, 'override', 2 FROM {_FIRST}")


def _sink_tables(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "table")
    sinks.write_table(demo.weekly(s, d).select("series_id", "date", "mm_pct", "regime"), path, ["regime"])
    return tidy(s.read.parquet(path), [*KEY, "regime"], ["mm_pct"])


add("sink_tables", _sink_tables, f"{FULL} SELECT series_id, date, regime, {r6('mm_pct')} AS mm_pct FROM weekly")
add("sink_safe_csv", lambda s, d: sinks.escape_formulas(demo.table(s, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "=").when(F.col("p_partkey") % 3 == 1, "@").otherwise(""), "p_name").alias("name"))),
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '''=' WHEN 1 THEN '''@' ELSE '' END || p_name AS name FROM part")

# --- cleaning -------------------------------------------------------------------

def _spelled() -> F.Column:
    """Order dates in several spellings, one order in four with none."""
    return F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyMMdd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", " yyyy-MM-dd ")).otherwise("bad")


add("parse_mixed_dates", lambda s, d: demo.table(s, d, "orders").select("o_orderkey", C.mixed_date(_spelled()).alias("date")), "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS date FROM orders")
add("coerce_numeric", lambda s, d: demo.table(s, d, "orders").withColumn("t", F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 5 == 1, "Infinity").otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))).select("o_orderkey", C.r6(C.number("t")).alias("x")),
    f"SELECT o_orderkey, {r6('CASE WHEN o_orderkey % 5 > 1 THEN o_totalprice END')} AS x FROM orders")


def _markets(s: SparkSession, d: str) -> DataFrame:
    p = demo.table(s, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("source_file"), F.col("p_type").alias("market"))
    return K.market_filter(p, "STANDARD", ["M"], ["SMALL"]).select("p_partkey", "source_file", "market")


add("market_filter", _markets, """WITH p AS (SELECT p_partkey, p_brand || '/' || p_size AS source_file, p_type AS market, max(CAST(p_type = 'STANDARD' AS INTEGER)) OVER (PARTITION BY p_brand, p_size) AS x FROM part)
SELECT p_partkey, source_file, market FROM p WHERE CASE WHEN x = 1 THEN market = 'STANDARD' ELSE contains(market, 'M') AND NOT contains(market, 'SMALL') END""")


def _dirty(s: SparkSession, d: str) -> DataFrame:
    """Daily price bars with faults that follow from their dates."""
    k = F.dayofmonth("date")
    return demo.prices(s, d).withColumns({"close": F.when(k == 5, 0.0).otherwise(F.col("close")), "open": F.when(k == 9, None).otherwise(F.col("open")), "high": F.when(k == 13, F.col("low") / 2).otherwise(F.col("high"))})


_DIRTY = f"WITH {PRICES}, dirty AS MATERIALIZED (SELECT series_id, date, CASE WHEN day(date) = 9 THEN NULL ELSE open END AS open, CASE WHEN day(date) = 13 THEN low / 2 ELSE high END AS high, low, CASE WHEN day(date) = 5 THEN 0.0 ELSE close END AS close, volume FROM prices)"
_REASON = "CASE WHEN close IS NULL OR close <= 0 THEN 'bad_close' WHEN open IS NULL OR high IS NULL OR low IS NULL OR open <= 0 OR high <= 0 OR low <= 0 THEN 'bad_ohlc' WHEN high < greatest(open, close, low) OR low > least(open, close) THEN 'bounds_inconsistent' END"
add("ohlc_quarantine", lambda s, d: _dirty(s, d).select(*KEY, K.bar_reason().alias("reason"), F.when(K.bar_reason().isNull() | (K.bar_reason() != "bad_close"), C.r6("close")).alias("kept_close")), f"{_DIRTY} SELECT series_id, date, {_REASON} AS reason, CASE WHEN coalesce({_REASON}, '') <> 'bad_close' THEN {r6('close')} END AS kept_close FROM dirty")
add("classify_source", lambda s, d: demo.table(s, d, "documents").select("doc_id", C.source_class(F.when(F.col("doc_id") % 4 == 0, "FRED series").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("yahoo "), "source")).when(F.col("doc_id") % 4 == 2, "").otherwise(F.col("source"))).alias("class"), C.true_text(F.when(F.col("doc_id") % 2 == 0, " True ").otherwise("no")).alias("flag")),
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'FRED' WHEN 1 THEN 'Yahoo' WHEN 2 THEN 'Missing' ELSE 'Other' END AS class, doc_id % 2 = 0 AS flag FROM documents")
_HOURLY = f"hourly AS MATERIALIZED (SELECT *, bar_start - INTERVAL 5 HOUR AS ny FROM ({sql.bars('hour')}))"
_SESS = "CAST(ny AS DATE) + CASE WHEN hour(ny) >= 18 THEN 1 ELSE 0 END"


def _hourly(s: SparkSession, d: str) -> DataFrame:
    return demo.bars(s, d).withColumns({"session_date": K.session_date("bar_start"), "bar_end": F.col("bar_start") + F.expr("interval 1 hour")})


add("hourly_session_date", lambda s, d: _hourly(s, d).select("series_id", "bar_start", "session_date"), f"WITH {_HOURLY} SELECT series_id, bar_start, {_SESS} AS session_date FROM hourly")


def _captured() -> tuple[F.Column, F.Column]:
    return F.lit("2024-01-03 00:00:00").cast("timestamp"), F.lit("2024-01-28 00:00:00").cast("timestamp")


add("hourly_bar_reject", lambda s, d: demo.bars(s, d).select("series_id", "bar_start", K.hourly_reason("bar_start", *_captured()).alias("reason")),
    f"""WITH {_HOURLY} SELECT series_id, bar_start, CASE WHEN bar_start < TIMESTAMP '2024-01-03' OR bar_start >= TIMESTAMP '2024-01-28' THEN 'outside_capture_window' WHEN hour(ny) = 17 OR (isodow(ny) = 5 AND hour(ny) >= 17) OR isodow(ny) = 6 OR (isodow(ny) = 7 AND hour(ny) < 18) THEN 'outside_regular_session'
WHEN {_REASON} IS NOT NULL THEN 'bounds_inconsistent' END AS reason FROM hourly""")  # fmt: skip
add("hourly_bar_end", lambda s, d: demo.table(s, d, "events").select(F.col("event_type").alias("series_id"), F.when(F.col("event_id") % 2 == 0, F.date_trunc("minute", "ts")).otherwise(F.date_trunc("second", "ts")).alias("ts")).distinct().select("series_id", "ts", K.bar_end("ts", _captured()[1], ["series_id"]).alias("bar_end")),
    """WITH e AS (SELECT DISTINCT event_type AS series_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS ts FROM events)
SELECT series_id, ts, least(ts + INTERVAL 1 HOUR, TIMESTAMP '2024-01-28', min(CASE WHEN second(ts) = 0 THEN ts END) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS bar_end FROM e""")  # fmt: skip
#: In the morning, after the close, and after the last bar: as of when, and the market's current stamp.
_GATES = {"morning": (AS_OF, "2024-01-24 11:00:00"), "evening": ("2024-01-24 23:00:00", "2024-01-24 22:00:00"), "end": ("2024-01-31 03:00:00", "2024-01-30 23:00:00")}


def _gates(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name, (at, market) in _GATES.items():
        one = K.complete_bars(demo.bars(s, d), "bar_start", at, F.lit(market).cast("timestamp"), ["series_id"]).select(F.lit(name).alias("gate"), "series_id", "bar_start")
        out = one if out is None else out.unionByName(one)
    return out


_GATE = ", ".join(f"('{n}', TIMESTAMP '{a}' - INTERVAL 5 HOUR, TIMESTAMP '{m}')" for n, (a, m) in _GATES.items())
add("complete_bar_gate", _gates, f"""WITH {_HOURLY}, g(gate, now, market) AS (VALUES {_GATE}), x AS (SELECT *, lead(bar_start) OVER (PARTITION BY series_id ORDER BY bar_start) IS NULL AS last FROM hourly)
SELECT gate, series_id, bar_start FROM x, g WHERE (CAST(ny AS DATE) < CAST(now AS DATE) OR (CAST(ny AS DATE) = CAST(now AS DATE) AND CAST(now AS TIME) >= TIME '17:15:00'))
AND NOT (last AND CAST(ny AS TIME) <> TIME '00:00:00' AND (bar_start = market OR CAST(ny AS DATE) = CAST(now AS DATE)))""")

# --- joins ----------------------------------------------------------------------


def _strict(s: SparkSession, d: str) -> DataFrame:
    """All reports with their price; unmatched: reports of the series without a price in time (the strict join refuses a series that has some)."""
    return J.asof_refused(demo.positions(s, d).select("series_id", "date", "oi"), demo.prices(s, d).select("series_id", "date", "close"), ["close"], 4)


_ASOF = "FROM positions p ASOF LEFT JOIN {r} r ON p.series_id = r.series_id AND p.date >= r.date"
_TIMELY = "p.date - r.date <= 4"
add("asof_price_strict", lambda s, d: tidy(_strict(s, d), [*KEY, "asof_date", "unmatched"], ["oi", "close"]),
    f"WITH {POSITIONS}, {PRICES} SELECT p.series_id, p.date, CASE WHEN {_TIMELY} THEN r.date END AS asof_date, count(*) FILTER (NOT coalesce({_TIMELY}, false)) OVER (PARTITION BY p.series_id) AS unmatched, {r6('oi')} AS oi, {r6(f'CASE WHEN {_TIMELY} THEN close END')} AS close {_ASOF.format(r='prices')}")
add("asof_by_days", lambda s, d: tidy(J.asof_by_days(demo.positions(s, d).select("series_id", "date", "oi"), demo.prices(s, d).select("series_id", "date", "close"), ["close"], 4), [*KEY, "asof_date"], ["oi", "close"]),
    f"WITH {POSITIONS}, {PRICES} SELECT p.series_id, p.date, CASE WHEN p.date - r.date <= 4 THEN r.date END AS asof_date, {r6('oi')} AS oi, {r6('CASE WHEN p.date - r.date <= 4 THEN close END')} AS close {_ASOF.format(r='prices')}")


def _benchmark(s: SparkSession, d: str) -> DataFrame:
    df = J.asof(demo.prices(s, d).select("series_id", "date", "close"), demo.alt_prices(s, d), ["alt_close"], tolerance_days=7)
    return df.withColumns({"diff": F.col("close") - F.col("alt_close"), "pct": C.ratio(F.col("close") - F.col("alt_close"), F.col("alt_close"))})


_BENCH = f"WITH {PRICES}, {ALT_PRICES}, bench AS MATERIALIZED (SELECT p.series_id, p.date, close, CASE WHEN p.date - r.date <= 7 THEN alt_close END AS alt_close FROM prices p ASOF LEFT JOIN alt_prices r ON p.series_id = r.series_id AND p.date >= r.date)"
add("asof_benchmark_compare", lambda s, d: tidy(_benchmark(s, d), KEY, ["close", "alt_close", "diff", "pct"]), f"{_BENCH} SELECT series_id, date, {r6('close')} AS close, {r6('alt_close')} AS alt_close, {r6('close - alt_close')} AS diff, {r6('(close - alt_close) / alt_close')} AS pct FROM bench")
add("event_week_bars", lambda s, d: tidy(J.event_week_bars(demo.prices(s, d), demo.weekly(s, d).filter("mm_pct >= 0.97"), 1), ["series_id", "event_date", "week_offset", "date"], ["close"]),
    f"{FULL}, e AS (SELECT series_id, date AS event_date, w FROM weekly, (SELECT unnest([-1, 0, 1]) AS w) WHERE mm_pct >= 0.97) SELECT p.series_id, event_date, w AS week_offset, p.date, {r6('p.close')} AS close FROM e JOIN prices p ON p.series_id = e.series_id AND CAST(date_trunc('week', p.date) AS DATE) = CAST(date_trunc('week', event_date) AS DATE) + 7 * w AND isodow(p.date) <= 5")
add("next_week_join", lambda s, d: tidy(J.next_week(demo.positions(s, d), demo.prices(s, d).select("series_id", "date", "close")), ["series_id", "report_date", "week_start", "bar_date"], ["close"]),
    f"WITH {POSITIONS}, {PRICES} SELECT p.series_id, p.date AS report_date, CAST(date_trunc('week', p.date) AS DATE) + 7 AS week_start, r.date AS bar_date, {r6('close')} AS close FROM positions p LEFT JOIN (SELECT * FROM prices WHERE isodow(date) <= 5) r ON p.series_id = r.series_id AND r.date BETWEEN CAST(date_trunc('week', p.date) AS DATE) + 7 AND CAST(date_trunc('week', p.date) AS DATE) + 11")


def _sessions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seen = demo.prices(s, d)
    ends = seen.groupBy("series_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ends.select("series_id", F.explode(F.sequence("a", "b")).alias("date")).filter(F.weekday("date") < 5), seen


add("session_antijoin", lambda s, d: J.differences(*_sessions(s, d), KEY), f"""WITH {PRICES}, x AS (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT series_id, min(date) AS a, max(date) AS b FROM prices GROUP BY ALL)), e AS (SELECT * FROM x WHERE isodow(date) <= 5)
SELECT series_id, date, 'missing' AS side FROM e ANTI JOIN prices USING (series_id, date) UNION ALL SELECT series_id, date, 'unexpected' AS side FROM prices ANTI JOIN e USING (series_id, date)""")
add("dataset_alignment", lambda s, d: J.alignment(demo.master(s, d), demo.weekly(s, d).filter("mm_pct is not null"), KEY), f"{FULL} SELECT count(*) FILTER (mm_pct IS NOT NULL) AS both, count(*) FILTER (mm_pct IS NULL) AS only_first, CAST(0 AS BIGINT) AS only_second FROM weekly")
add("union_latest", lambda s, d: tidy(K.union_latest([(1, demo.prices(s, d).filter(F.year("date") <= 1998).select(*KEY, "close")), (2, demo.alt_prices(s, d).filter(F.year("date") >= 1998).select(*KEY, F.col("alt_close").alias("close")))], KEY), [*KEY, "source_rank"], ["close"]),
    f"WITH {PRICES}, {ALT_PRICES}, u AS (SELECT series_id, date, close, 1 AS k FROM prices WHERE year(date) <= 1998 UNION ALL SELECT series_id, date, alt_close, 2 FROM alt_prices WHERE year(date) >= 1998) SELECT series_id, date, CAST(max(k) AS INTEGER) AS source_rank, {r6('arg_max(close, k)')} AS close FROM u GROUP BY ALL")


def _refresh(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = demo.prices(s, d).filter("date <= '2001-01-31'")
    new = _dirty(s, d).filter("date >= '2000-12-01'")
    return old, new.withColumn("close", F.when(F.dayofmonth("date") == 7, F.col("low")).otherwise(F.col("close")))


def _merged(s: SparkSession, d: str) -> DataFrame:
    old, new = _refresh(s, d)
    return K.merge_bars(old, new.select(old.columns), KEY)


_NEW = f"{_DIRTY}, nw AS (SELECT * REPLACE (CASE WHEN day(date) = 7 THEN low ELSE close END AS close) FROM dirty WHERE date >= DATE '2000-12-01'), ok AS (SELECT * FROM nw WHERE {_REASON} IS NULL), od AS (SELECT * FROM prices WHERE date <= DATE '2001-01-31')"
add("incremental_merge", lambda s, d: tidy(_merged(s, d), KEY, ["open", "high", "low", "close"]), f"{_NEW} SELECT series_id, date, {', '.join(f'{r6(f'CASE WHEN ok.series_id IS NULL THEN od.{c} ELSE ok.{c} END')} AS {c}' for c in ('open', 'high', 'low', 'close'))} FROM od FULL JOIN ok USING (series_id, date)")
_D = lambda x: F.lit(x).cast("date")
add("incremental_merge_checks", lambda s, d: K.merge_problems(*_refresh(s, d), KEY, _D("2000-12-01"), _D("2001-04-01"), _D("1995-01-01")),
    f"{_NEW} SELECT (SELECT count(*) FROM (SELECT series_id, date FROM nw GROUP BY ALL HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM (SELECT * FROM od WHERE date >= DATE '2000-12-01') ANTI JOIN nw USING (series_id, date)) AS lost, (SELECT count(*) FROM nw WHERE {_REASON} IS NOT NULL AND date >= DATE '2001-04-01') AS invalid_recent, CAST(0 AS BIGINT) AS cold")


def _gated(s: SparkSession, d: str) -> DataFrame:
    """The same old bars under a batch with faults, which is rejected whole, and under a sound one."""
    old, faulty = _refresh(s, d)
    sound = demo.prices(s, d).filter("date >= '2000-12-01'")
    run = lambda name, new: K.merge_checked(old, new.select(old.columns), KEY, _D("2000-12-01"), _D("2001-04-01"), _D("1995-01-01"), rejected="keep").select(F.lit(name).alias("batch"), *KEY, "close")
    return tidy(run("faulty", faulty).unionByName(run("sound", sound)), ["batch", *KEY], ["close"])


add("incremental_merge_gate", _gated, f"""{_NEW}, c AS (SELECT (SELECT count(*) FROM (SELECT series_id, date FROM nw GROUP BY ALL HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT * FROM od WHERE date >= DATE '2000-12-01') ANTI JOIN nw USING (series_id, date)) + (SELECT count(*) FROM nw WHERE {_REASON} IS NOT NULL AND date >= DATE '2001-04-01') AS faults),
m AS (SELECT series_id, date, CASE WHEN ok.series_id IS NULL THEN od.close ELSE ok.close END AS close FROM od FULL JOIN ok USING (series_id, date))
SELECT 'faulty' AS batch, series_id, date, {r6('close')} AS close FROM od, c WHERE faults > 0 UNION ALL SELECT 'faulty', series_id, date, {r6('close')} FROM m, c WHERE faults = 0 UNION ALL SELECT 'sound', series_id, date, {r6('close')} FROM prices""")


def _twice(s: SparkSession, d: str) -> DataFrame:
    p = demo.prices(s, d)
    again = p.filter(F.dayofmonth("date") <= 3).withColumn("close", F.when(F.dayofmonth("date") == 2, F.col("close") + 1).otherwise(F.col("close") + 0.0001))
    return K.duplicate_bars(p.withColumn("copy", F.lit(0)).unionByName(again.withColumn("copy", F.lit(1))), KEY, ["copy"])


add("duplicate_bars", lambda s, d: tidy(_twice(s, d), [*KEY, "kind"], ["close"], ["nth"]), f"WITH {PRICES} SELECT series_id, date, CASE WHEN day(date) = 2 THEN 'conflict' ELSE 'identical_duplicate' END AS kind, {r6('close + CASE WHEN day(date) = 2 THEN 1 ELSE 0.0001 END')} AS close, CAST(2 AS BIGINT) AS nth FROM prices WHERE day(date) <= 3")

# --- aggregates -----------------------------------------------------------------

add("missing_profile", lambda s, d: tidy(K.missing_profile(demo.weekly(s, d).select("r1", "r8", "f8", "mm_pct", "close_z", "close")), ["column"], ["share"], ["nulls"]),
    f"{FULL}, c AS ({' UNION ALL '.join(f'SELECT {chr(39)}{c}{chr(39)} AS \"column\", count(*) - count({c}) AS nulls, count(*) AS n FROM weekly' for c in ('r1', 'r8', 'f8', 'mm_pct', 'close_z', 'close'))}) SELECT \"column\", {r6('nulls / CAST(n AS DOUBLE)')} AS share, nulls FROM c WHERE nulls > 0")


def hourly_to_daily(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id", F.to_date("bar_start").alias("date")).agg(F.min_by("open", "bar_start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_start").alias("close"), F.sum("volume").alias("volume"))


add("hourly_to_daily", lambda s, d: tidy(hourly_to_daily(demo.bars(s, d)), KEY, ["open", "high", "low", "close"], ["volume"]), f"WITH {_DAILY} SELECT series_id, date, {', '.join(f'{r6(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume FROM daily")


def _source_audit(s: SparkSession, d: str) -> DataFrame:
    """Rows, dates and values of each feed, and how far both are apart."""
    b = _benchmark(s, d)
    part = lambda name, c: b.groupBy("series_id").agg(F.lit(name).alias("feed"), F.count(c).alias("n"), F.min(F.when(F.col(c).isNotNull(), F.col("date"))).alias("first"), F.max(F.when(F.col(c).isNotNull(), F.col("date"))).alias("last"), F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(F.abs("pct")).alias("mean_pct"), F.max(F.abs("pct")).alias("max_pct"))
    return tidy(part("primary", "close").unionByName(part("benchmark", "alt_close")), ["series_id", "feed", "first", "last"], ["mean", "low", "high", "mean_pct", "max_pct"], ["n"])


add("source_audit", _source_audit, f"{_BENCH}, z AS (SELECT *, abs((close - alt_close) / alt_close) AS pct FROM bench) " + " UNION ALL ".join(f"SELECT series_id, '{n}' AS feed, min(date) FILTER ({c} IS NOT NULL) AS first, max(date) FILTER ({c} IS NOT NULL) AS last, {r6(f'avg({c})')} AS mean, {r6(f'min({c})')} AS low, {r6(f'max({c})')} AS high, {r6('avg(pct)')} AS mean_pct, {r6('max(pct)')} AS max_pct, count({c}) AS n FROM z GROUP BY ALL" for n, c in (("primary", "close"), ("benchmark", "alt_close"))))

# --- outcomes -------------------------------------------------------------------


def reports(s: SparkSession, d: str) -> DataFrame:
    """For each series and each week of bars a report of the Tuesday before."""
    return demo.bars(s, d, "day").select("series_id", F.date_sub(F.date_trunc("week", "date").cast("date"), 6).alias("report_date")).distinct()


def weeks(s: SparkSession, d: str) -> DataFrame:
    return O.expectation(reports(s, d), *_calendar(s, d))


def week_outcomes(s: SparkSession, d: str, as_of: str = AS_OF) -> DataFrame:
    hourly = _hourly(s, d).filter(K.hourly_reason("bar_start", F.lit("1970-01-01").cast("timestamp"), F.lit("2100-01-01").cast("timestamp")).isNull())
    return O.outcomes(weeks(s, d), demo.bars(s, d, "day").filter(K.bar_reason().isNull()), hourly, as_of)


_RK = ["series_id", "report_date", "week_start"]
_EXP = f"""{_DAILY}, {_HOURLY}, fm AS (SELECT min(date_trunc('week', date)) AS m FROM daily), rp AS (SELECT DISTINCT series_id, CAST(date_trunc('week', date) AS DATE) AS week_start FROM daily),
wk AS MATERIALIZED (SELECT series_id, week_start - 6 AS report_date, week_start, week_start + 4 AS week_end, CASE WHEN k = 3 THEN [week_start, week_start + 1] WHEN k IN (0, 2) THEN [week_start + 1, week_start + 2, week_start + 3, week_start + 4] ELSE [week_start, week_start + 1, week_start + 2, week_start + 3, week_start + 4] END AS expected,
k IN (0, 2, 3) AS holiday, CASE WHEN k = 3 THEN 46 WHEN k IN (0, 2) THEN NULL ELSE 115 END AS expected_hours FROM (SELECT *, (week_start - CAST(m AS DATE)) // 7 AS k FROM rp, fm))"""
add("week_expectation", lambda s, d: weeks(s, d).select(*_RK, "week_end", "holiday", F.col("expected_hours").cast("long").alias("expected_hours"), F.size("expected").cast("long").alias("n_expected"), F.array_join(F.transform("expected", lambda x: x.cast("string")), ",").alias("expected")),
    f"WITH {_EXP} SELECT series_id, report_date, week_start, week_end, holiday, CAST(expected_hours AS BIGINT) AS expected_hours, len(expected) AS n_expected, array_to_string(list_transform(expected, lambda x: CAST(x AS VARCHAR)), ',') AS expected FROM wk")
_OUTC = f"""{_EXP}, kd AS (SELECT * FROM daily WHERE isodow(date) <= 5 AND date + INTERVAL 22 HOUR <= TIMESTAMP '{AS_OF}' AND {_REASON} IS NULL),
kh AS (SELECT *, {_SESS} AS session_date FROM hourly WHERE bar_start + INTERVAL 1 HOUR <= TIMESTAMP '{AS_OF}' AND NOT (hour(ny) = 17 OR (isodow(ny) = 5 AND hour(ny) >= 17) OR isodow(ny) = 6 OR (isodow(ny) = 7 AND hour(ny) < 18)) AND {_REASON} IS NULL),
dd AS (SELECT series_id, CAST(date_trunc('week', date) AS DATE) AS week_start, list(date ORDER BY date) AS dates, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close FROM kd GROUP BY ALL),
hh AS (SELECT series_id, CAST(date_trunc('week', session_date) AS DATE) AS week_start, count(*) AS n_hours, max(high) AS hh, min(low) AS hl FROM kh WHERE isodow(session_date) <= 5 GROUP BY ALL),
j AS (SELECT wk.*, TIMESTAMP '{AS_OF}' < week_start - INTERVAL 1 HOUR AS pending, TIMESTAMP '{AS_OF}' >= week_end + INTERVAL 22 HOUR AS ended, coalesce(dates, []) AS dates, open, high, low, close, coalesce(n_hours, 0) AS n_hours, hh, hl FROM wk LEFT JOIN dd USING (series_id, week_start) LEFT JOIN hh USING (series_id, week_start)),
oc AS MATERIALIZED (SELECT *, len(list_filter(expected, lambda x: NOT list_contains(dates, x))) AS n_missing, len(list_filter(dates, lambda x: NOT list_contains(expected, x))) AS n_unexpected FROM j),
ow AS MATERIALIZED (SELECT *, CASE WHEN pending THEN 'PENDING' WHEN NOT ended THEN 'PARTIAL' WHEN len(dates) = 0 THEN 'MISSING' WHEN n_missing = 0 AND n_unexpected = 0 THEN 'COMPLETE_DAILY' ELSE 'PARTIAL' END AS coverage, CASE WHEN pending THEN 'PENDING' WHEN ended THEN 'ENDED' ELSE 'IN_PROGRESS' END AS week_state,
CASE WHEN pending THEN 'PENDING' WHEN n_hours = 0 THEN 'MISSING' WHEN expected_hours IS NULL OR n_hours <> expected_hours THEN 'PARTIAL' ELSE 'COMPLETE_OBSERVED_HOURLY' END AS hourly_coverage FROM oc)"""
_PX = ["open", "high", "low", "close", "change", "change_pct", "range", "range_pct"]
add("week_coverage", lambda s, d: week_outcomes(s, d).select(*_RK, "coverage", "week_state", F.size("days").cast("long").alias("n_days"), F.size("missing").cast("long").alias("n_missing"), F.size("unexpected").cast("long").alias("n_unexpected")),
    f"WITH {_OUTC} SELECT series_id, report_date, week_start, coverage, week_state, len(dates) AS n_days, n_missing, n_unexpected FROM ow")
add("week_outcome", lambda s, d: tidy(week_outcomes(s, d), _RK, _PX), f"WITH {_OUTC} SELECT series_id, report_date, week_start, {r6('open')} AS open, {r6('high')} AS high, {r6('low')} AS low, {r6('close')} AS close, {r6('close - open')} AS change, {r6('(close - open) / nullif(open, 0)')} AS change_pct, {r6('high - low')} AS range, {r6('(high - low) / nullif(open, 0)')} AS range_pct FROM ow")
add("hourly_coverage", lambda s, d: week_outcomes(s, d).select(*_RK, "hourly_coverage", F.size("hours").cast("long").alias("n_hours")), f"WITH {_OUTC} SELECT series_id, report_date, week_start, hourly_coverage, CASE WHEN pending THEN 0 ELSE n_hours END AS n_hours FROM ow")
_X = f"""{_OUTC}, xd AS (SELECT ow.series_id, ow.week_start, list(k.date ORDER BY k.date) FILTER (abs(k.high - ow.high) <= 0.0005) AS hd, list(k.date ORDER BY k.date) FILTER (abs(k.low - ow.low) <= 0.0005) AS ld FROM ow JOIN kd k ON k.series_id = ow.series_id AND CAST(date_trunc('week', k.date) AS DATE) = ow.week_start GROUP BY ALL),
xh AS (SELECT ow.series_id, ow.week_start, list(h.session_date ORDER BY h.bar_start) FILTER (abs(h.high - ow.high) <= 0.0005) AS hs, list(h.session_date ORDER BY h.bar_start) FILTER (abs(h.low - ow.low) <= 0.0005) AS ls, min(h.bar_start) FILTER (abs(h.high - ow.high) <= 0.0005) AS hb, min(h.bar_start) FILTER (abs(h.low - ow.low) <= 0.0005) AS lb FROM ow JOIN kh h ON h.series_id = ow.series_id AND isodow(h.session_date) <= 5 AND CAST(date_trunc('week', h.session_date) AS DATE) = ow.week_start GROUP BY ALL),
x AS MATERIALIZED (SELECT ow.*, coalesce(hd, []) AS hd, coalesce(ld, []) AS ld, hs, ls, hb, lb FROM ow LEFT JOIN xd USING (series_id, week_start) LEFT JOIN xh USING (series_id, week_start))"""


def _reason_sql(d: str, s: str, top: str, px: str) -> str:
    return f"CASE WHEN len(dates) = 0 THEN 'NO_DAILY_BARS' WHEN n_hours = 0 THEN 'NO_HOURLY_BARS' WHEN abs({top} - {px}) > 0.0005 THEN 'DAILY_HOURLY_EXTREME_MISMATCH' WHEN {s}[1] <> {d}[1] OR len(list_filter({s}, lambda q: NOT list_contains({d}, q))) > 0 THEN 'DAILY_HOURLY_SESSION_MISMATCH' WHEN hourly_coverage = 'COMPLETE_OBSERVED_HOURLY' THEN 'MATCHED_FIRST_OBSERVED_HOUR_BUCKET' ELSE 'MATCHED_OBSERVED_BUCKET_INCOMPLETE_HOURLY_COVERAGE' END"


add("outcome_coverage_summary", lambda s, d: week_outcomes(s, d).groupBy("coverage").agg(F.count("*").alias("n"), F.count_if(F.col("high_hours") > 0).alias("n_high_hours"), F.count_if(F.col("low_hours") > 0).alias("n_low_hours")),
    f"WITH {_X}, y AS (SELECT *, {_reason_sql('hd', 'hs', 'hh', 'high')} AS high_reason, {_reason_sql('ld', 'ls', 'hl', 'low')} AS low_reason FROM x) SELECT coverage, count(*) AS n, count(*) FILTER (starts_with(high_reason, 'MATCHED')) AS n_high_hours, count(*) FILTER (starts_with(low_reason, 'MATCHED')) AS n_low_hours FROM y GROUP BY ALL")
add("extreme_details", lambda s, d: week_outcomes(s, d).select(*_RK, "high_date", "low_date", F.size("high_dates").cast("long").alias("n_high"), F.size("low_dates").cast("long").alias("n_low"), "high_reason", "low_reason", "high_start", "low_start"),
    f"""WITH {_X}, y AS (SELECT *, {_reason_sql('hd', 'hs', 'hh', 'high')} AS high_reason, {_reason_sql('ld', 'ls', 'hl', 'low')} AS low_reason FROM x) SELECT series_id, report_date, week_start, hd[1] AS high_date, ld[1] AS low_date, len(hd) AS n_high, len(ld) AS n_low, high_reason, low_reason,
CASE WHEN starts_with(high_reason, 'MATCHED') THEN hb END AS high_start, CASE WHEN starts_with(low_reason, 'MATCHED') THEN lb END AS low_start FROM y""")  # fmt: skip
add("extreme_order", lambda s, d: week_outcomes(s, d).select(*_RK, "order"), f"WITH {_X} SELECT series_id, report_date, week_start, CASE WHEN hd[1] IS NULL OR ld[1] IS NULL THEN 'UNKNOWN' WHEN hd[1] < ld[1] THEN 'HIGH_THEN_LOW' WHEN ld[1] < hd[1] THEN 'LOW_THEN_HIGH' ELSE 'SAME_DAY_UNKNOWN' END AS \"order\" FROM x")


def _evidence(s: SparkSession, d: str) -> DataFrame:
    """Publication evidence that follows from the report dates: scheduled on Friday, later or with a time stamp in some weeks."""
    r = reports(s, d).select("report_date").distinct().withColumn("k", F.weekofyear("report_date") % 5)
    return r.select(
        "report_date", F.date_add("report_date", F.when(F.col("k") == 1, 9).otherwise(3)).alias("scheduled"), F.when(F.col("k") == 2, F.date_add("report_date", 6)).when(F.col("k") == 3, F.date_add("report_date", 3)).alias("actual_date"),
        F.when(F.col("k") == 4, F.date_add("report_date", 3).cast("timestamp") + F.expr("interval 20 hours 30 minutes")).alias("actual_ts"), F.lit(True).alias("has_source"), (F.col("k") == 3).alias("revision_risk"),
    )


def available(s: SparkSession, d: str) -> DataFrame:
    df = week_outcomes(s, d).select(*_RK, "opens", "closes")
    return O.availability(J.release_join(df, _evidence(s, d)))


_EVI = f"""{_EXP}, ev AS (SELECT *, week(report_date) % 5 AS k FROM wk), av AS MATERIALIZED (SELECT *, report_date + CASE WHEN k = 1 THEN 9 ELSE 3 END AS scheduled, CASE WHEN k = 2 THEN report_date + 6 WHEN k = 3 THEN report_date + 3 END AS actual_date, CASE WHEN k = 4 THEN report_date + 3 + INTERVAL 1230 MINUTE END AS actual_ts,
week_start - INTERVAL 1 HOUR AS opens, week_end + INTERVAL 22 HOUR AS closes FROM ev), st AS (SELECT *, CASE WHEN actual_ts IS NOT NULL THEN CASE WHEN actual_ts > opens THEN 'ACTUAL_RELEASE_AFTER_WEEK_START' ELSE 'ACTUAL_RELEASE_BEFORE_WEEK_START' END
WHEN actual_date IS NOT NULL THEN CASE WHEN actual_date + INTERVAL 5 HOUR >= opens THEN 'ACTUAL_PUBLICATION_DATE_AFTER_WEEK_START' WHEN actual_date + INTERVAL 29 HOUR <= opens THEN 'ACTUAL_PUBLICATION_DATE_BEFORE_WEEK_START' ELSE 'ACTUAL_PUBLICATION_DATE_OVERLAPS_WEEK_START' END
WHEN scheduled + INTERVAL 5 HOUR >= opens THEN 'SCHEDULED_AFTER_WEEK_START' ELSE 'RELEASE_TIME_UNVERIFIED' END AS status FROM av)"""
add("release_evidence_join", lambda s, d: J.release_join(reports(s, d), _evidence(s, d)).select("series_id", "report_date", "scheduled", "actual_date", "actual_ts"), f"WITH {_EVI} SELECT series_id, report_date, scheduled, actual_date, actual_ts FROM av")
add("research_availability", lambda s, d: available(s, d).select(*_RK, "status", "relation", "eligible"), f"""WITH {_EVI} SELECT series_id, report_date, week_start, status, CASE WHEN scheduled + INTERVAL 5 HOUR >= closes THEN 'AFTER_OUTCOME_WEEK' WHEN scheduled + INTERVAL 5 HOUR >= opens THEN 'DURING_OUTCOME_WEEK' WHEN scheduled + INTERVAL 29 HOUR <= opens THEN 'BEFORE_OUTCOME_WEEK' ELSE 'OVERLAPS_WEEK_START_DATE' END AS relation,
CASE WHEN contains(status, '_AFTER_') THEN false WHEN contains(status, '_BEFORE_') AND k <> 3 THEN true END AS eligible FROM st""")
_DATES = lambda k: F.array(F.date_add("week_start", k))
add("coverage_diagnosis", lambda s, d: week_outcomes(s, d).select(*_RK, O.diagnosis(_DATES(0), _DATES(1), _DATES(3)).alias("category")),
    f"""WITH {_OUTC}, g AS (SELECT *, list_filter(expected, lambda x: NOT list_contains(dates, x)) AS gone FROM ow), m AS (SELECT *, list_contains(gone, week_start) AS bad, list_contains(gone, week_start + 1) AS empty, list_contains(gone, week_start + 3) AS sure, list_contains(gone, week_start + 1) OR list_contains(gone, week_start + 2) OR list_contains(gone, week_start + 4) AS loose FROM g)
SELECT series_id, report_date, week_start, CASE WHEN pending THEN 'PENDING' WHEN coverage = 'COMPLETE_DAILY' THEN CASE WHEN holiday THEN 'VERIFIED_HOLIDAY_SHORTENED_COMPLETE' ELSE 'COMPLETE_EXPECTED_LABELS' END WHEN bad THEN CASE WHEN loose THEN 'QUARANTINED_OHLC_AND_UNVERIFIED_GAP' WHEN sure THEN 'QUARANTINED_OHLC_AND_CONFIRMED_GAP' ELSE 'QUARANTINED_OHLC' END
WHEN sure THEN CASE WHEN loose THEN 'CONFIRMED_SOURCE_GAP_AND_UNVERIFIED_GAP' ELSE 'CONFIRMED_SOURCE_GAP' END WHEN empty THEN 'SOURCE_NULL_UNVERIFIED_CALENDAR' ELSE 'UNVERIFIED_CALENDAR_OR_SOURCE_GAP' END AS category FROM m""")  # fmt: skip


_KEPT = ["coverage", "hourly_coverage", "days", "expected", "missing", "unexpected", "open", "high", "low", "close", *[f"{x}_{y}" for x in ("high", "low") for y in ("reason", "start", "end", "hours")]]


def _archive(s: SparkSession, d: str) -> DataFrame:
    """All outcomes of AS_OF over those of a week before, which hold the outcomes of a retired series too."""
    now, before = (week_outcomes(s, d, t).select("series_id", "report_date", "closes", *_KEPT) for t in (AS_OF, BEFORE))
    retired = before.filter("series_id = 'click'").withColumn("series_id", F.lit("retired"))
    return O.archive_merge(now, before.unionByName(retired), "2024-01-13 00:00:00")


_RUN = f"""(WITH {{o}}, y AS (SELECT *, {_reason_sql('hd', 'hs', 'hh', 'high')} AS high_reason, {_reason_sql('ld', 'ls', 'hl', 'low')} AS low_reason FROM x)
SELECT series_id, report_date, week_end + INTERVAL 22 HOUR AS closes, coverage, hourly_coverage, CASE WHEN NOT pending THEN dates ELSE [] END AS dates, expected, open, high, low, close, high_reason, low_reason,
CASE WHEN starts_with(high_reason, 'MATCHED') THEN hb END AS high_start, CASE WHEN starts_with(low_reason, 'MATCHED') THEN lb END AS low_start FROM y)"""
_CLOSE = " AND ".join(f"abs(c.{x} - p.{x}) <= 0.0005" for x in ("open", "high", "low", "close"))
_SAME = "list_filter(c.{a}, lambda q: NOT list_contains(c.{b}, q)) = list_filter(p.{a}, lambda q: NOT list_contains(p.{b}, q))"
_OLD = lambda c: f"CASE WHEN starts_with(archive_status, 'ARCHIVED') THEN p.{c} ELSE c.{c} END"
_HOURS = lambda c: f"CASE WHEN contains(archive_status, 'ARCHIVED') THEN p.{c} ELSE c.{c} END AS {c}"
add("archive_merge", lambda s, d: tidy(_archive(s, d), ["series_id", "report_date", "archive_status", "coverage", "hourly_coverage", "high_reason", "low_reason", "high_start", "low_start"], ["close"]),
    f"""WITH c AS (SELECT * FROM {_RUN.format(o=_X)}), b AS (SELECT * FROM {_RUN.format(o=_X.replace(AS_OF, BEFORE))}), p AS (SELECT * FROM b UNION ALL SELECT * REPLACE ('retired' AS series_id) FROM b WHERE series_id = 'click'),
j AS (SELECT series_id, report_date, c, p, CASE WHEN c.coverage IS NULL THEN 'ARCHIVED_OUT_OF_SCOPE' WHEN p.closes < TIMESTAMP '2024-01-13' AND p.coverage = 'COMPLETE_DAILY' THEN 'ARCHIVED_COMPLETE'
WHEN {_CLOSE} AND c.dates = p.dates AND c.coverage = p.coverage AND c.hourly_coverage <> 'COMPLETE_OBSERVED_HOURLY' AND p.hourly_coverage <> 'MISSING'
AND (c.coverage = 'COMPLETE_DAILY' OR (c.coverage = 'PARTIAL' AND c.expected = p.expected AND {_SAME.format(a='expected', b='dates')} AND {_SAME.format(a='dates', b='expected')})) THEN 'CURRENT_DAILY_WITH_ARCHIVED_HOURLY' ELSE 'CURRENT_QUERY' END AS archive_status FROM c FULL JOIN p USING (series_id, report_date))
SELECT series_id, report_date, archive_status, {_OLD('coverage')} AS coverage, {_HOURS('hourly_coverage')}, {_HOURS('high_reason')}, {_HOURS('low_reason')}, {_HOURS('high_start')}, {_HOURS('low_start')}, {r6(_OLD('close'))} AS close FROM j""")  # fmt: skip


def _sink_outcomes(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "outcomes")
    sinks.write_outcomes(week_outcomes(s, d), path)
    back = s.read.csv(f"{path}/csv", header=True)
    nested = s.read.schema("series_id string, report_date date, days array<struct<date: date>>").json(f"{path}/json")
    return back.select("series_id", F.to_date("report_date").alias("report_date"), "coverage", C.r6(F.col("close").cast("double")).alias("close")).join(nested.select("series_id", "report_date", F.size("days").cast("long").alias("n_days")), ["series_id", "report_date"])


add("sink_outcomes", _sink_outcomes, f"WITH {_OUTC} SELECT series_id, report_date, coverage, {r6('close')} AS close, len(dates) AS n_days FROM ow")

# --- quality --------------------------------------------------------------------


def freshness(s: SparkSession, d: str) -> DataFrame:
    parts = {"positions": demo.positions(s, d), "prices": demo.prices(s, d), "alt_prices": demo.alt_prices(s, d), "bars": demo.bars(s, d, "day").withColumn("series_id", F.lit("events"))}
    return Q.freshness(parts, {"positions": "2001-07-31", "prices": "2001-08-05", "alt_prices": "2001-10-01", "bars": "2024-02-10"}, "2001-08-12")


_FR = {"positions": ("positions", "date", "2001-07-31"), "prices": ("prices", "date", "2001-08-05"), "alt_prices": ("alt_prices", "date", "2001-10-01"), "bars": ("events", "CAST(ts AS DATE)", "2024-02-10")}
add("freshness", freshness, f"WITH {POSITIONS}, {PRICES}, {ALT_PRICES}, l AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS component, max({c}) AS latest, DATE {chr(39)}{e}{chr(39)} AS expected FROM {t}' for n, (t, c, e) in _FR.items())}) SELECT component, latest, expected, latest >= expected - 3 AS current, CASE WHEN DATE '2001-08-12' - latest <= 10 THEN 'fresh' WHEN DATE '2001-08-12' - latest <= 21 THEN 'ageing' ELSE 'old' END AS age, CASE WHEN bool_and(latest >= expected - 3) OVER () THEN 'OK' WHEN bool_or(latest >= expected - 3) OVER () THEN 'PARTIAL_STALE' ELSE 'STALE' END AS overall FROM l")
def _validated(s: SparkSession, d: str) -> DataFrame:
    """The weekly table in the order of a file in which the rows of a 13th stand before their predecessors."""
    row = F.row_number().over(weekly.W.by_series()) * 2
    return Q.validate_weekly(demo.weekly(s, d).withColumn("place", row - F.when(F.dayofmonth("date") == 13, 3).otherwise(0)), "place")


add("validate_weekly", _validated, f"""{FULL}, o AS (SELECT *, count(*) OVER (PARTITION BY series_id, date) AS k, {sql.trailing('close', 1)} AS again, 2 * row_number() OVER (PARTITION BY series_id ORDER BY date) - CASE WHEN day(date) = 13 THEN 3 ELSE 0 END AS place FROM weekly),
x AS (SELECT *, coalesce(lag(date) OVER (PARTITION BY series_id ORDER BY place) >= date, false) AS late FROM o) SELECT series_id, count(*) AS n, count(*) FILTER (k > 1) AS repeated, count(*) FILTER (close IS NULL OR close <= 0) AS bad_close, count(*) FILTER (abs(mm_long - mm_short - mm_net) > 0.001) AS bad_net,
count(*) FILTER (mm_pct < 0 OR mm_pct > 1 OR oi_pct < 0 OR oi_pct > 1) AS bad_percentile, count(*) FILTER (abs(again - r1) > 1e-8) AS bad_return, count(*) FILTER (late) AS not_increasing FROM x GROUP BY ALL""")
add("validate_outcomes", lambda s, d: Q.validate_outcomes(week_outcomes(s, d)), f"""WITH {_OUTC} SELECT series_id, count(*) AS n, count(*) FILTER (week_start <> CAST(date_trunc('week', report_date) AS DATE) + 7) AS wrong_week, count(*) FILTER (pending AND close IS NOT NULL) AS pending_with_prices, count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close)) AS bad_bounds, CAST(0 AS BIGINT) AS bad_ratio FROM ow GROUP BY ALL""")
add("history_coverage", lambda s, d: Q.history_coverage(demo.positions(s, d), demo.prices(s, d)), f"WITH {POSITIONS}, {PRICES}, p AS (SELECT series_id, min(date) AS a, max(date) AS b FROM positions GROUP BY ALL), q AS (SELECT series_id, min(date) AS first_price, max(date) AS last_price FROM prices GROUP BY ALL) SELECT series_id, first_price, last_price, first_price <= CAST(date_trunc('week', a) AS DATE) + 7 AS starts_in_time, last_price >= b AS reaches_end FROM p LEFT JOIN q USING (series_id)")


add("feed_check", lambda s, d: Q.foreign_rows(demo.prices(s, d).withColumn("source", F.when((F.col("series_id") == "ASIA") & (F.dayofmonth("date") == 1), "other feed").otherwise("Yahoo GC=F")), "GC=F"),
    f"WITH {PRICES} SELECT series_id, count(*) AS n, count(*) FILTER (series_id = 'ASIA' AND day(date) = 1) AS n_foreign, count(*) FILTER (series_id = 'ASIA' AND day(date) = 1) = 0 AS usable FROM prices GROUP BY ALL")
NOW = "2001-08-12 12:00:00"


def _release(s: SparkSession, d: str) -> DataFrame:
    """Freshness under checks of two sources: in each run one source is in order, the other's check is old in the second run."""
    last = demo.positions(s, d).agg(F.max("date").alias("observed"))
    source = lambda name, fetched: last.select(F.lit(name).alias("name"), F.lit(fetched).cast("timestamp").alias("fetched_at"), "observed", F.lit("a").alias("sha256"), F.lit("a").alias("file_sha256"))
    one = lambda run, fetched: Q.release_status(freshness(s, d), source("reports", "2001-08-12 09:00:00").unionByName(source("prices", fetched)), NOW, "reports", "bars").select(F.lit(run).alias("run"), "status", "n_errors", F.array_join("stale", ",").alias("stale"), "observed", "normal")
    return one("checked", "2001-08-12 09:00:00").unionByName(one("old", "2001-08-10 09:00:00"))


_LATEST = f"WITH {POSITIONS}, {PRICES}, {ALT_PRICES}, l AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS component, max({c}) AS latest, DATE {chr(39)}{e}{chr(39)} AS expected FROM {t}' for n, (t, c, e) in _FR.items())})"
add("release_status", _release, f"""{_LATEST}, a AS (SELECT coalesce(string_agg(component, ',' ORDER BY component) FILTER (NOT coalesce(latest >= expected - 3, false)), '') AS stale, count(*) FILTER (latest IS NULL) AS lost, count(*) FILTER (component = 'bars' AND NOT coalesce(latest >= expected - 3, false)) AS hub FROM l),
b AS (SELECT max(date) AS observed, CAST(date_trunc('week', DATE '2001-08-12') AS DATE) + 1 AS normal FROM positions) SELECT run, CASE WHEN run = 'old' THEN 'SOURCE_UNVERIFIED' WHEN lost > 0 THEN 'ERROR' WHEN hub > 0 THEN 'STALE' WHEN stale <> '' THEN 'PARTIAL_STALE' WHEN observed < normal THEN 'AWAITING_RELEASE' ELSE 'OK' END AS status,
CAST(CASE WHEN run = 'old' THEN 1 ELSE 0 END AS BIGINT) AS n_errors, stale, observed, normal FROM a, b, (SELECT unnest(['checked', 'old']) AS run)""")


def _ruled(s: SparkSession, d: str) -> DataFrame:
    """Outcomes with planted faults: revised reports are called eligible, reports from 2024-01-20 on are unknown, release times of one series are later than their status says, highs of another have hours that nothing matched."""
    df = O.availability(J.release_join(week_outcomes(s, d), _evidence(s, d)))
    late = F.when(F.col("series_id") == "view", F.col("actual_ts") + F.expr("interval 10 days")).otherwise(F.col("actual_ts"))
    hour = F.when(F.col("series_id") == "click", F.coalesce("high_start", "opens")).otherwise(F.col("high_start"))
    df = df.withColumns({"eligible": F.when(F.col("revision_risk"), True).otherwise(F.col("eligible")), "actual_ts": late, "high_start": hour})
    return Q.outcome_rules(df, reports(s, d).filter("report_date < '2024-01-20'"))


_PROVEN = "coalesce(actual_ts + CASE WHEN series_id = 'view' THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END <= opens OR status = 'ACTUAL_PUBLICATION_DATE_BEFORE_WEEK_START', false)"
add("outcome_rules", _ruled, f"""WITH {_X}{_EVI[len(_EXP):]}, y AS (SELECT *, {_reason_sql('hd', 'hs', 'hh', 'high')} AS high_reason FROM x),
r AS (SELECT *, CASE WHEN k = 3 THEN true WHEN contains(status, '_AFTER_') THEN false WHEN contains(status, '_BEFORE_') THEN true END AS el, count(*) OVER (PARTITION BY series_id, report_date) AS again FROM y JOIN (SELECT series_id, report_date, k, status, actual_ts, opens FROM st) USING (series_id, report_date))
SELECT series_id, count(*) AS n, count(*) FILTER (report_date >= DATE '2024-01-20') AS unknown_date, count(*) FILTER (again > 1) AS repeated_date, count(*) FILTER (coverage = 'PENDING' AND (close IS NOT NULL)) AS pending_with_results, count(*) FILTER (coverage = 'COMPLETE_DAILY' AND NOT coalesce(open > 0 AND high > 0 AND low > 0 AND close > 0, false)) AS complete_without_prices,
count(*) FILTER (el AND NOT {_PROVEN}) AS eligible_without_evidence, count(*) FILTER (el AND k = 3) AS risky_but_eligible, count(*) FILTER (contains(status, '_AFTER_') AND coalesce(el, true)) AS late_but_not_excluded,
count(*) FILTER (series_id = 'click' AND NOT starts_with(high_reason, 'MATCHED')) AS hour_without_match FROM r GROUP BY ALL""")
add("outcomes_alignment", lambda s, d: J.alignment(week_outcomes(s, d), reports(s, d).filter("report_date < '2024-01-20'"), ["series_id", "report_date"]),
    f"WITH {_EXP} SELECT count(*) FILTER (report_date < DATE '2024-01-20') AS both, count(*) FILTER (report_date >= DATE '2024-01-20') AS only_first, CAST(0 AS BIGINT) AS only_second FROM wk")


_HUB = ["close", "mm_pct", "oi_pct", "lifecycle_state", "regime", "weekly_state", "reading"]


def hub(s: SparkSession, d: str) -> DataFrame:
    """One record for each series: its latest weekly row and states, what followed similar weeks, its price history, and the health of these.

    The master is written first, so that adaptive execution does not plan the many windows anew after each of
    its stages; they stand on one partitioning by series, and their frame is written once.
    """
    base = stored(demo.master(s, d), "master")
    df = weekly.with_readings(demo.structure(s, d, demo.lifecycle(s, d, demo.weekly(s, d, base))))
    frame = stored(weekly.weekly_changes(s, d, df).withColumnRenamed("state", "weekly_state"), "hub-frame")
    complete = F.lit(True)
    for f in FEATURES:
        complete = complete & F.col(f).isNotNull()
    last = frame.groupBy("series_id").agg(F.max("date").alias("date"), F.max_by(F.struct(*_HUB), "date").alias("r"), F.count(F.lit(1)).alias("master_rows"), F.max(F.when(complete, F.col("date"))).alias("case_date"))
    out = last.select("series_id", "date", "r.*", "master_rows", "case_date")
    out = out.join(tendencies(s, d, frame).select("series_id", "tendency", "confidence", "cases"), "series_id", "left")
    out = out.join(Q.history_coverage(frame, demo.prices(s, d)).select("series_id", "reaches_end"), "series_id", "left")
    current = F.coalesce(F.col("case_date") == F.col("date"), F.lit(False))
    out = out.withColumns({"market_state": C.market_state("mm_pct", "oi_pct"), "cases": F.coalesce("cases", F.lit(0)), "health": F.when(current, "ok").otherwise("partial_stale"), "stale": F.when(current, "").otherwise("cases")})
    keep = ["series_id", "date", "lifecycle_state", "regime", "weekly_state", "reading", "tendency", "confidence", "reaches_end", "market_state", "case_date", "health", "stale"]
    return tidy(out, keep, ["close", "mm_pct", "oi_pct"], ["master_rows", "cases"])


#: What follows the structure view in the SQL of readings.
_READ = weekly.READING_SQL.split(sql.STRUCTURE, 1)[1]
add("hub_summary", hub, f"""{TEND}, {sql.LIFECYCLE}, {sql.STRUCTURE}{_READ}, {weekly._CH_SQL}, n1 AS (SELECT series_id, max(date) AS date, {', '.join(f'arg_max({c}, date) AS {c}' for c in ('close', 'mm_pct', 'oi_pct', 'lifecycle_state', 'regime'))} FROM life GROUP BY ALL),
n2 AS (SELECT series_id, arg_max({weekly._STATE_SQL}, date) AS weekly_state FROM ch GROUP BY ALL), n3 AS (SELECT series_id, arg_max(reading, date) AS reading FROM rd GROUP BY ALL), n4 AS (SELECT p.series_id, max(r.d) >= max(p.date) AS reaches_end FROM positions p JOIN (SELECT series_id, max(date) AS d FROM prices GROUP BY ALL) r USING (series_id) GROUP BY ALL),
n5 AS (SELECT series_id, count(*) AS master_rows, max(date) FILTER ({' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}) AS case_date FROM weekly GROUP BY ALL), n6 AS (SELECT series_id, count(*) AS k FROM cases GROUP BY ALL)
SELECT series_id, date, lifecycle_state, regime, weekly_state, reading, tendency, confidence, reaches_end, {weekly._MS.format(m='(mm_pct * 100)', o='(oi_pct * 100)', h='Healthy High Positioning')} AS market_state, case_date, CASE WHEN case_date = date THEN 'ok' ELSE 'partial_stale' END AS health, CASE WHEN case_date = date THEN '' ELSE 'cases' END AS stale,
{r6('close')} AS close, {r6('mm_pct')} AS mm_pct, {r6('oi_pct')} AS oi_pct, master_rows, coalesce(k, 0) AS cases FROM n1 LEFT JOIN n2 USING (series_id) LEFT JOIN n3 USING (series_id) LEFT JOIN tend USING (series_id) LEFT JOIN n4 USING (series_id) LEFT JOIN n5 USING (series_id) LEFT JOIN n6 USING (series_id)""")

# --- streams --------------------------------------------------------------------

_STREAM = "WITH h AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS bar_start, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL), m AS (SELECT max(ts) AS t FROM events)"
add("stream_bars", lambda s, d: tidy(B.replay_bars(s, f"{d}/events.parquet"), ["series_id", "bar_start"], ["open", "high", "low", "close"], ["volume"]), f"{_STREAM} SELECT series_id, bar_start, {', '.join(f'{r6(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, volume FROM h, m WHERE bar_start + INTERVAL 1 HOUR <= t - INTERVAL 10 MINUTE")
add("stream_upsert_bars", lambda s, d: tidy(B.replay_upserts(s, _merged_source(s, d)), KEY, ["open", "high", "low", "close"]), f"{_DIRTY} SELECT series_id, date, {', '.join(f'{r6(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))} FROM dirty WHERE {_REASON} IS NULL")


def _merged_source(s: SparkSession, d: str) -> str:
    path = scratch(s, "bar-feed")
    _dirty(s, d).select(*KEY, "open", "high", "low", "close").write.parquet(path)
    return path


