"""What prices did in the week after each report: expectation, coverage, extremes, availability, archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import next_week_start, ratio
from .clean import NEW_YORK, PRICES, TOLERANCE

KEYS = ("series_id", "report_date")
FULL_HOURS = 115
#: Columns of an outcome that follow from its hours.
HOURLY = {"hourly_coverage", "expected_hours", "hours", "order"} | {f"{side}_{c}" for side in ("high", "low") for c in ("reason", "start", "end", "hours")}


def new_york(date: Column, hour: int) -> Column:
    """The UTC instant of an hour of a New York date."""
    return F.to_utc_timestamp(date.cast("timestamp") + F.make_dt_interval(hours=F.lit(hour)), NEW_YORK)


def expectation(reports: DataFrame, excluded: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """reports with week_start, week_end, expected dates, holiday flag and expected hourly bars (null in short weeks).

    excluded is a calendar of single dates: it is collected into one array, a few
    bytes a holiday, and joined to each week.
    """
    days = excluded.agg(F.coalesce(F.array_sort(F.collect_set("date")), F.array().cast("array<date>")).alias("__off")).withColumn("__i", F.lit(1))
    df = reports.withColumn("week_start", next_week_start("report_date")).withColumn("week_end", F.date_add("week_start", 4))
    df = df.withColumn("__i", F.lit(1)).join(F.broadcast(days), "__i").drop("__i")
    week = F.sequence("week_start", "week_end")
    df = df.withColumn("expected", F.array_except(week, "__off")).withColumn("holiday", F.size("expected") < 5).drop("__off")
    if overrides is not None:
        o = overrides.select("week_start", F.transform("expected_daily_dates", lambda d: F.to_date(d)).alias("__e"), F.col("holiday_affected").alias("__h"), F.col("expected_hourly_bars").alias("__x"))
        df = df.join(o, "week_start", "left").withColumns({"expected": F.coalesce("__e", "expected"), "holiday": F.coalesce("__h", "holiday")})
        return df.withColumn("expected_hours", F.coalesce("__x", F.when(~F.col("holiday"), FULL_HOURS))).drop("__e", "__h", "__x")
    return df.withColumn("expected_hours", F.when(~F.col("holiday"), FULL_HOURS))


def outcomes(weeks: DataFrame, daily: DataFrame, hourly: DataFrame, as_of: str) -> DataFrame:
    """One row for each report with the prices, coverage and extremes of its week as they were known at as_of.

    weeks comes from expectation; daily has date and prices, hourly has bar_start,
    bar_end, session_date and prices. Each side becomes one row a week with short
    arrays before it is joined.
    """
    now = F.lit(as_of).cast("timestamp")
    week = lambda c: F.date_trunc("week", c).cast("date").alias("week_start")
    day = F.struct("date", *PRICES)
    known = daily.filter((F.weekday("date") < 5) & (new_york(F.col("date"), 17) <= now))
    days = known.groupBy("series_id", week("date")).agg(F.array_sort(F.collect_list(day)).alias("days"))
    hour = F.struct("bar_start", "bar_end", "session_date", *PRICES)
    seen = hourly.filter((F.weekday("session_date") < 5) & (F.col("bar_end") <= now))
    hours = seen.groupBy("series_id", week("session_date")).agg(F.array_sort(F.collect_list(hour)).alias("hours"))
    df = weeks.join(days, ["series_id", "week_start"], "left").join(hours, ["series_id", "week_start"], "left")
    opens, closes = new_york(F.date_sub("week_start", 1), 18), new_york(F.col("week_end"), 17)
    df = df.withColumns({"opens": opens, "closes": closes, "pending": now < opens})
    for c, like in (("days", days), ("hours", hours)):
        empty = F.array().cast(like.schema[c].dataType)
        df = df.withColumn(c, F.when(F.col("pending"), empty).otherwise(F.coalesce(c, empty)))
    seen_dates = F.transform("days", lambda d: d["date"])
    df = df.withColumns({"missing": F.array_except("expected", seen_dates), "unexpected": F.array_except(seen_dates, "expected"), "week_state": F.when(F.col("pending"), "PENDING").when(now >= closes, "ENDED").otherwise("IN_PROGRESS")})
    whole = (F.size("missing") == 0) & (F.size("unexpected") == 0)
    status = F.when(F.col("pending"), "PENDING").when(now < closes, "PARTIAL").when(F.size("days") == 0, "MISSING").when(whole, "COMPLETE_DAILY").otherwise("PARTIAL")
    df = df.withColumns({"coverage": status, "hourly_coverage": F.when(F.col("pending"), "PENDING").otherwise(hourly_coverage())})
    has = F.size("days") > 0
    price = lambda c, f: F.when(has, f(F.transform("days", lambda d: d[c])))
    df = df.withColumns({"open": price("open", lambda a: F.try_element_at(a, F.lit(1))), "close": price("close", lambda a: F.try_element_at(a, F.lit(-1))), "high": price("high", F.array_max), "low": price("low", F.array_min)})
    df = df.withColumns({"change": F.col("close") - F.col("open"), "range": F.col("high") - F.col("low")})
    df = df.withColumns({"change_pct": ratio(F.col("change"), F.col("open")), "range_pct": ratio(F.col("range"), F.col("open"))})
    for side in ("high", "low"):
        df = extreme(df, side)
    return df.withColumn("order", extreme_order())


def hourly_coverage() -> Column:
    """COMPLETE only if the hours are exactly the grid of 5 sessions of 23 full hours from 18:00 the day before."""
    n = F.size("hours")
    short = F.exists("hours", lambda h: h["bar_end"] != h["bar_start"] + F.expr("interval 1 hour"))
    grid = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda d: F.transform(F.sequence(F.lit(18), F.lit(40)), lambda k: F.to_utc_timestamp(F.date_add(F.date_sub("week_start", 1), d).cast("timestamp") + F.make_dt_interval(hours=k), NEW_YORK))))
    same = F.array_sort(F.transform("hours", lambda h: h["bar_start"])) == F.array_sort(grid)
    return F.when(n == 0, "MISSING").when(F.col("expected_hours").isNull() | (n != F.col("expected_hours")) | short, "PARTIAL").when((F.col("expected_hours") == FULL_HOURS) & ~F.col("holiday") & ~same, "PARTIAL").otherwise("COMPLETE_OBSERVED_HOURLY")


def extreme(df: DataFrame, side: str) -> DataFrame:
    """Dates of the week's high or low, and its first hour where the hourly bars agree with the daily ones."""
    days = F.transform(F.filter("days", lambda d: F.abs(d[side] - F.col(side)) <= TOLERANCE), lambda d: d["date"])
    df = df.withColumn(f"{side}_dates", days)
    top = F.transform("hours", lambda h: h[side])
    hourly_top = F.array_max(top) if side == "high" else F.array_min(top)
    match = F.filter("hours", lambda h: F.abs(h[side] - F.col(side)) <= TOLERANCE)
    df = df.withColumns({f"{side}_date": F.get(f"{side}_dates", F.lit(0)), "__m": match, "__top": hourly_top})
    stray = F.exists("__m", lambda h: ~F.array_contains(f"{side}_dates", h["session_date"])) | (F.get("__m", F.lit(0))["session_date"] != F.col(f"{side}_date"))
    reason = (
        F.when(F.size("days") == 0, "NO_DAILY_BARS").when(F.size("hours") == 0, "NO_HOURLY_BARS").when(F.abs(F.col("__top") - F.col(side)) > TOLERANCE, "DAILY_HOURLY_EXTREME_MISMATCH")
        .when(stray, "DAILY_HOURLY_SESSION_MISMATCH").when(F.col("hourly_coverage") == "COMPLETE_OBSERVED_HOURLY", "MATCHED_FIRST_OBSERVED_HOUR_BUCKET").otherwise("MATCHED_OBSERVED_BUCKET_INCOMPLETE_HOURLY_COVERAGE")
    )
    df = df.withColumn(f"{side}_reason", reason)
    hit = F.col(f"{side}_reason").startswith("MATCHED")
    return df.withColumns({f"{side}_start": F.when(hit, F.get("__m", F.lit(0))["bar_start"]), f"{side}_end": F.when(hit, F.get("__m", F.lit(0))["bar_end"]), f"{side}_hours": F.when(hit, F.size("__m")).otherwise(0)}).drop("__m", "__top")


def extreme_order() -> Column:
    sure = (F.col("high_reason") == "MATCHED_FIRST_OBSERVED_HOUR_BUCKET") & (F.col("low_reason") == "MATCHED_FIRST_OBSERVED_HOUR_BUCKET")
    return (
        F.when(F.col("high_date").isNull() | F.col("low_date").isNull(), "UNKNOWN").when(F.col("high_date") < F.col("low_date"), "HIGH_THEN_LOW").when(F.col("low_date") < F.col("high_date"), "LOW_THEN_HIGH")
        .when(~sure, "SAME_DAY_UNKNOWN").when(F.col("high_end") <= F.col("low_start"), "HIGH_THEN_LOW").when(F.col("low_end") <= F.col("high_start"), "LOW_THEN_HIGH").otherwise("SAME_BUCKET_UNKNOWN")
    )


def availability(df: DataFrame) -> DataFrame:
    """df with status and eligible: was the report public before its outcome week opened?

    Takes scheduled, actual_date (civil dates of New York), actual_ts, has_source and
    revision_risk. A date alone never becomes a time: it counts as the whole day.
    """
    begin = lambda c: new_york(F.col(c), 0)
    end = lambda c: new_york(F.date_add(c, 1), 0)
    o = F.col("opens")
    by_date = F.when(begin("actual_date") >= o, "ACTUAL_PUBLICATION_DATE_AFTER_WEEK_START").when(end("actual_date") <= o, "ACTUAL_PUBLICATION_DATE_BEFORE_WEEK_START").otherwise("ACTUAL_PUBLICATION_DATE_OVERLAPS_WEEK_START")
    status = (
        F.when(F.col("actual_ts").isNotNull(), F.when(F.col("actual_ts") > o, "ACTUAL_RELEASE_AFTER_WEEK_START").otherwise("ACTUAL_RELEASE_BEFORE_WEEK_START"))
        .when(F.col("actual_date").isNotNull(), by_date).when((begin("scheduled") >= o) & F.col("has_source"), "SCHEDULED_AFTER_WEEK_START").otherwise("RELEASE_TIME_UNVERIFIED")
    )
    df = df.withColumn("status", status)
    eligible = F.when(F.col("status").contains("_AFTER_"), False).when(F.col("status").contains("_BEFORE_"), True)
    relation = (
        F.when(F.col("scheduled").isNull(), "UNKNOWN").when(begin("scheduled") >= F.col("closes"), "AFTER_OUTCOME_WEEK").when(begin("scheduled") >= o, "DURING_OUTCOME_WEEK")
        .when(end("scheduled") <= o, "BEFORE_OUTCOME_WEEK").otherwise("OVERLAPS_WEEK_START_DATE")
    )
    risky = F.coalesce("revision_risk", F.lit(False))
    return df.withColumns({"relation": relation, "eligible": F.when(risky & eligible, None).otherwise(eligible)})


def diagnosis(quarantined: Column, nulls: Column, confirmed: Column) -> Column:
    """The kind of gap of a week: arrays of dates that were quarantined, null at the source, or confirmed as trading days."""
    gone = F.when(F.col("coverage") != "PENDING", F.col("missing")).otherwise(F.array().cast("array<date>"))
    bad = F.array_intersect(gone, quarantined)
    null = F.array_intersect(gone, nulls)
    sure = F.array_except(F.array_intersect(gone, confirmed), bad)
    unknown = F.size(F.array_except(F.array_except(F.array_except(gone, bad), null), sure)) > 0
    loose = unknown | (F.size(F.array_except(null, sure)) > 0)
    done = F.when(F.col("holiday"), "VERIFIED_HOLIDAY_SHORTENED_COMPLETE").otherwise("COMPLETE_EXPECTED_LABELS")
    quarantine = F.when(loose, "QUARANTINED_OHLC_AND_UNVERIFIED_GAP").when(F.size(sure) > 0, "QUARANTINED_OHLC_AND_CONFIRMED_GAP").otherwise("QUARANTINED_OHLC")
    gap = F.when(loose, "CONFIRMED_SOURCE_GAP_AND_UNVERIFIED_GAP").otherwise("CONFIRMED_SOURCE_GAP")
    return (
        F.when(F.col("coverage") == "PENDING", "PENDING").when(F.col("coverage") == "COMPLETE_DAILY", done).when(F.size(bad) > 0, quarantine)
        .when(F.size(sure) > 0, gap).when(F.size(null) > 0, "SOURCE_NULL_UNVERIFIED_CALENDAR").otherwise("UNVERIFIED_CALENDAR_OR_SOURCE_GAP")
    )


SESSIONS = ("expected", "missing", "unexpected")


def archive_merge(current: DataFrame, previous: DataFrame, window_start: str) -> DataFrame:
    """Outcomes with an earlier run: complete weeks that closed before the queried window stay as they were; hours of the earlier run, and the extremes found by them, stay where daily prices and coverage agree; rows of the earlier run alone are kept.

    Both have KEYS, closes, coverage, prices, days, hourly_coverage, and expected, missing and
    unexpected dates, in which weeks that are PARTIAL must agree too.
    """
    cols = [c for c in current.columns if c not in KEYS]
    for name, df in (("current", current), ("previous", previous)):
        absent = [c for c in ("closes", "coverage", "hourly_coverage", "days", *PRICES, *SESSIONS, *cols) if c not in df.columns]
        if absent:
            raise ValueError(f"{name} outcomes lack {absent}")
    a, b = current.select(*KEYS, F.struct(*cols).alias("c")), previous.select(*KEYS, F.struct(*cols).alias("p"))
    both = a.join(b, list(KEYS), "full_outer")
    old = (F.col("p.closes") < F.lit(window_start).cast("timestamp")) & (F.col("p.coverage") == "COMPLETE_DAILY")
    close_to = F.lit(True)
    for c in PRICES:
        close_to = close_to & (F.abs(F.col(f"c.{c}") - F.col(f"p.{c}")) <= TOLERANCE)
    same_days = F.transform("c.days", lambda d: d["date"]) == F.transform("p.days", lambda d: d["date"])
    sessions = F.lit(True)
    for c in SESSIONS:
        sessions = sessions & F.col(f"c.{c}").eqNullSafe(F.col(f"p.{c}"))
    known = (F.col("c.coverage") == "COMPLETE_DAILY") | ((F.col("c.coverage") == "PARTIAL") & sessions)
    agrees = close_to & same_days & known & (F.col("c.coverage") == F.col("p.coverage")) & (F.col("c.hourly_coverage") != "COMPLETE_OBSERVED_HOURLY")
    status = F.when(F.col("c").isNull(), "ARCHIVED_OUT_OF_SCOPE").when(old, "ARCHIVED_COMPLETE").when(agrees & (F.col("p.hourly_coverage") != "MISSING"), "CURRENT_DAILY_WITH_ARCHIVED_HOURLY").otherwise("CURRENT_QUERY")
    both = both.withColumn("archive_status", F.coalesce(status, F.lit("CURRENT_QUERY")))
    keep = F.col("archive_status").startswith("ARCHIVED")
    out = both.withColumn("r", F.when(keep, F.col("p")).otherwise(F.col("c")))
    restored = F.col("archive_status") == "CURRENT_DAILY_WITH_ARCHIVED_HOURLY"
    hours = lambda c: F.when(restored, F.col(f"p.{c}")).otherwise(F.col(f"r.{c}")).alias(c)
    return out.select(*KEYS, "archive_status", *[hours(c) if c in HOURLY else F.col(f"r.{c}").alias(c) for c in cols])
