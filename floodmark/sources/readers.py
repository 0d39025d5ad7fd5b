"""Readers of landed files: positioning reports, closes, bars, chart and calendar documents."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import mixed_date, number
from .paths import stored_checked

#: Accepted column names of positioning reports, for each of ours.
ALIASES: Mapping[str, Sequence[str]] = {
    "market": ("Market_and_Exchange_Names", "Market and Exchange Names"),
    "date": ("Report_Date_as_YYYY-MM-DD", "Report_Date_as_MM_DD_YYYY", "As_of_Date_Form_YYYY-MM-DD", "As_of_Date_In_Form_YYMMDD"),
    "oi": ("Open_Interest_All",),
    "mm_long": ("M_Money_Positions_Long_All",),
    "mm_short": ("M_Money_Positions_Short_All",),
    "producer_long": ("Prod_Merc_Positions_Long_All",),
    "producer_short": ("Prod_Merc_Positions_Short_All",),
    "swap_long": ("Swap_Positions_Long_All",),
    "swap_short": ("Swap__Positions_Short_All", "Swap_Positions_Short_All"),
}
MEASURES = [k for k in ALIASES if k not in ("market", "date")]


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def resolve(columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = ALIASES) -> dict[str, str]:
    """Our names to those of the file: exact first, then without case and signs. Fails on a missing one."""
    trimmed = {c.strip(): c for c in columns}
    loose = {_plain(c): c for c in reversed(list(columns))}
    out = {}
    for name, wanted in aliases.items():
        hit = next((trimmed[w] for w in wanted if w in trimmed), None) or next((loose[_plain(w)] for w in wanted if _plain(w) in loose), None)
        if hit is None:
            raise ValueError(f"no column for {name} among {list(columns)}")
        out[name] = hit
    return out


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def normalise_positions(raw: DataFrame) -> DataFrame:
    """series_id, date and measures of a raw report; bad numbers and dates become null."""
    found = resolve(raw.columns)
    text = raw.select(*[F.col(_quoted(c)).cast("string").alias(n) for n, c in found.items()])
    return text.select(F.trim("market").alias("series_id"), mixed_date("date").alias("date"), *[number(m).alias(m) for m in MEASURES])


def read_positions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Positioning reports with a header, in ISO-8859-1."""
    return normalise_positions(spark.read.csv(path, header=True, encoding="ISO-8859-1"))


def read_headerless(spark: SparkSession, path: str, header: Sequence[str]) -> DataFrame:
    """A report without header takes that of an archive. Fails if it is a web page or holds other than futures alone.

    Lines are read once: the checks ride on the write of the landed rows. A line with another
    number of fields than the header is a fault too.
    """
    names = [h.strip() for h in header]
    lines = spark.read.option("encoding", "ISO-8859-1").text(path).filter(F.trim("value") != "")
    types = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, "__more"])
    fields = F.from_csv("value", F.lit(types), {"ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE"})
    rows = lines.select("value", fields.alias("f")).select("value", "f.*")
    page = F.lower(F.col("value")).rlike("<(html|!doctype|head|body)")
    kind = next((c for c in names if _plain(c) == "futonlyorcombined"), None)
    checks = {"web page": page, "fields too many": ~page & F.col("__more").isNotNull(), "fields too few": ~page & F.col(_quoted(names[-1])).isNull() & (F.size(F.split("value", ",")) < len(names))}
    if kind:
        checks["not FutOnly"] = ~page & (F.coalesce(F.trim(_quoted(kind)), F.lit("")) != "FutOnly")
    return normalise_positions(stored_checked(rows, "headerless", checks, message=f"{path} is not a report of futures alone", drop=["value", "__more"]))


def read_closes(spark: SparkSession, path: str, feed: str) -> DataFrame:
    """series_id, date, close of daily closes; '.' is missing. Fails if a row's source does not name the feed; the file is read once for that and its rows."""
    raw = spark.read.csv(path, header=True, nullValue=".")
    names = resolve(raw.columns, {"series_id": ("series_id",), "date": ("Date", "observation_date"), "close": ("Close", "value"), "source": ("Source",)})
    df = raw.select(*[F.col(_quoted(c)).alias(n) for n, c in names.items()])
    other = ~F.coalesce(F.lower("source"), F.lit("")).contains(feed.lower())
    out = df.select("series_id", mixed_date("date").alias("date"), number("close").alias("close"), other.alias("__other"))
    told = F.concat_ws(" ", "series_id", F.col("date").cast("string"))
    return stored_checked(out, "closes", {"rows of another source": F.col("__other")}, told=told, message=f"not all come from {feed}", drop=["__other"])


def read_ohlc(spark: SparkSession, path: str, default_source: str = "unknown") -> DataFrame:
    """Daily bars; rows without a date or one of open, high, low, close are dropped."""
    raw = spark.read.schema("series_id string, date string, open string, high string, low string, close string, volume string, source string").csv(path, header=True)
    df = raw.select("series_id", mixed_date("date").alias("date"), *[number(c).alias(c) for c in ("open", "high", "low", "close", "volume")], F.coalesce("source", F.lit(default_source)).alias("source"))
    return df.na.drop(subset=["date", "open", "high", "low", "close"])


_CHART = """struct<chart: struct<result: array<struct<meta: struct<symbol: string, exchangeTimezoneName: string, dataGranularity: string>, timestamp: array<bigint>,
indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>>>>>>"""


def parse_chart_json(df: DataFrame, column: str) -> DataFrame:
    """One row for each bar of chart documents with parallel arrays: symbol, ts and values."""
    doc = F.from_json(column, _CHART)["chart"]["result"][0]
    q = doc["indicators"]["quote"][0]
    zipped = F.arrays_zip(doc["timestamp"].alias("t"), *[q[c].alias(c) for c in ("open", "high", "low", "close", "volume")])
    rows = df.select(doc["meta"]["symbol"].alias("symbol"), F.posexplode(zipped).alias("position", "bar"))
    return rows.select("symbol", "position", F.timestamp_seconds("bar.t").alias("ts"), *[F.col(f"bar.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])


_WEEK = "struct<expected_daily_dates: array<string>, expected_hourly_bars: int, holiday_affected: boolean, note: string, hourly_coverage_known_partial: boolean>"
_CALENDAR = f"""no_daily_bar_dates array<string>, daily_excluded_dates array<string>, holidays array<struct<date: string, daily_bar_expected: boolean, exclude_daily: boolean, settlement_status: string, normal_trading_confirmed: boolean, source_url: string>>,
weekly_overrides map<string, {_WEEK}>, trade_date_overrides map<string, string>, override_source_url string, normal_session struct<source_url: string>, sources array<string>,
historical_price_quality_evidence struct<quarantined_ohlc_dates: array<string>, source_null_dates: array<string>>"""


def read_calendar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Excluded dates, and overrides by week_start, of a session calendar."""
    doc = spark.read.schema(_CALENDAR).json(path, multiLine=True)
    skipped = F.filter("holidays", lambda h: (h["daily_bar_expected"] == F.lit(False)) | (h["exclude_daily"] == F.lit(True)))
    dates = F.array_union(F.concat(F.coalesce("no_daily_bar_dates", F.array().cast("array<string>")), F.coalesce("daily_excluded_dates", F.array().cast("array<string>"))), F.coalesce(F.transform(skipped, lambda h: h["date"]), F.array().cast("array<string>")))
    excluded = doc.select(F.explode(dates).alias("d")).select(F.to_date("d").alias("date")).distinct()
    weeks = doc.select(F.explode(F.coalesce("weekly_overrides", F.create_map().cast(f"map<string, {_WEEK}>"))).alias("w", "o"))
    return excluded, weeks.select(F.to_date("w").alias("week_start"), "o.*")


def read_calendar_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a session calendar proves besides.

    dates: date and kind ('quarantined', 'null_at_source', 'confirmed': a normal day of trading with a source).
    trade_dates: calendar_date and the trade_date that it counts as. notices: position, kind ('general',
    'normal_session', 'override', 'holiday'), date (of a holiday) and url.
    """
    doc = spark.read.schema(_CALENDAR).json(path, multiLine=True)
    held = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    sure = F.filter("holidays", lambda h: (h["exclude_daily"] == F.lit(False)) & (F.coalesce(h["settlement_status"] == "normal_schedule", F.lit(False)) | F.coalesce(h["normal_trading_confirmed"], F.lit(False))) & (F.coalesce(h["source_url"], F.lit("")) != ""))
    kinds = {"quarantined": F.col("historical_price_quality_evidence.quarantined_ohlc_dates"), "null_at_source": F.col("historical_price_quality_evidence.source_null_dates"), "confirmed": F.transform(sure, lambda h: h["date"])}
    kind_of = lambda k: lambda d: F.struct(F.to_date(d).alias("date"), F.lit(k).alias("kind"))
    dates = doc.select(F.explode(F.flatten(F.array(*[F.transform(held(c), kind_of(k)) for k, c in kinds.items()]))).alias("x")).select("x.*").distinct()
    trade = doc.select(F.explode(F.coalesce("trade_date_overrides", F.create_map().cast("map<string, string>"))).alias("c", "t")).select(F.to_date("c").alias("calendar_date"), F.to_date("t").alias("trade_date"))
    note = lambda kind, url, date=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("date") if date is None else F.to_date(date)).alias("date"), url.alias("url"))
    days = F.transform(F.coalesce("holidays", F.array().cast(doc.schema["holidays"].dataType)), lambda h: note("holiday", h["source_url"], h["date"]))
    notices = F.concat(F.transform(held(F.col("sources")), lambda u: note("general", u)), F.array(note("normal_session", F.col("normal_session.source_url")), note("override", F.col("override_source_url"))), days)
    return dates, trade, doc.select(F.posexplode(notices).alias("position", "x")).select("position", "x.*").filter(F.coalesce("url", F.lit("")) != "")


def week_sources(weeks: DataFrame, overrides: DataFrame, trade_dates: DataFrame, notices: DataFrame) -> DataFrame:
    """weeks (week_start, week_end) with sources: the notices that apply to each, in the order of the calendar, each url once.

    General ones and that of the normal session always apply, holidays in their week, the one of
    overrides where the week has an override or a trade date of its own. A calendar is one document; weeks are distinct here.
    """
    spans = weeks.select("week_start", "week_end").distinct()
    monday = F.date_trunc("week", "date").cast("date")
    first = notices.groupBy("url").agg(F.min("position").alias("__at"))
    always = notices.filter(F.col("kind").isin("general", "normal_session")).agg(F.collect_set("url").alias("__u")).withColumn("__i", F.lit(1))
    changed = overrides.select("week_start").unionByName(trade_dates.select(F.date_trunc("week", "calendar_date").cast("date").alias("week_start"), "calendar_date").filter(F.weekday("calendar_date") < 5).select("week_start")).distinct()
    by_week = notices.filter("kind = 'holiday' and weekday(date) < 5").select(monday.alias("week_start"), "url")
    by_week = by_week.unionByName(changed.withColumn("kind", F.lit("override")).join(notices.filter("kind = 'override'").select("kind", "url"), "kind").select("week_start", "url"))
    own = by_week.groupBy("week_start").agg(F.collect_set("url").alias("__w"))
    rows = spans.withColumn("__i", F.lit(1)).join(F.broadcast(always), "__i", "left").join(own, "week_start", "left")
    none = F.array().cast("array<string>")
    rows = rows.select("week_start", F.explode(F.array_union(F.coalesce("__u", none), F.coalesce("__w", none))).alias("url")).join(first, "url")
    listed = rows.groupBy("week_start").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "url"))), lambda x: x["url"]).alias("sources"))
    return spans.join(listed, "week_start", "left").withColumn("sources", F.coalesce("sources", none))


def load_weekly(df: DataFrame, required: Sequence[str], drop_null: Sequence[str] = ("date",)) -> DataFrame:
    """A weekly table with the required columns (else it fails), numbers coerced, rows without date dropped."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    texts = [c for c, t in df.dtypes if t == "string" and c not in ("series_id", "split", "regime", "date")]
    out = df.withColumns({c: number(c) for c in texts})
    if dict(df.dtypes)["date"] == "string":
        out = out.withColumn("date", mixed_date("date"))
    return out.na.drop(subset=list(drop_null))
