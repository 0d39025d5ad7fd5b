"""Checks of tables: freshness, validity, coverage. Each is one pass with counts of violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import source_class
from .clean import NEW_YORK
from .similarity import similar_states
from .windows import by_series, trailing

#: The classes of price sources, in the order of a report.
SOURCE_CLASSES = ("FRED", "Yahoo", "Stooq", "Other", "Missing")


def freshness(parts: Mapping[str, DataFrame], expected: Mapping[str, str], today: str, slack_days: int = 3, date: str = "date") -> DataFrame:
    """component, latest, expected, current, age and the overall state of all components."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.max(date).alias("latest")).select(F.lit(name).alias("component"), "latest", F.lit(expected[name]).cast("date").alias("expected"))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("current", F.coalesce(F.datediff("expected", "latest") <= slack_days, F.lit(False)))
    age = F.datediff(F.lit(today).cast("date"), F.col("latest"))
    out = out.withColumn("age", F.when(age <= 10, "fresh").when(age <= 21, "ageing").otherwise("old"))
    state = out.agg(F.every("current").alias("__all"), F.some("current").alias("__any"))  # one row
    overall = F.when(F.col("__all"), "OK").when(F.col("__any"), "PARTIAL_STALE").otherwise("STALE")
    return out.withColumn("__i", F.lit(1)).join(F.broadcast(state.withColumn("__i", F.lit(1))), "__i").withColumn("overall", overall).drop("__i", "__all", "__any")


def validate_weekly(df: DataFrame, position: str | None = None) -> DataFrame:
    """For each series the rows, and those that break a rule. position: a column with the place of a row in its file, for rows whose date is not after the one before."""
    w = by_series()
    again = trailing("close", 1, w)
    df = df.withColumns({"__again": again, "__same": F.coalesce(F.lag("date", 1).over(w) == F.col("date"), F.lit(False)) | F.coalesce(F.lead("date", 1).over(w) == F.col("date"), F.lit(False))})
    share = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    more = []
    if position:
        df = df.withColumn("__late", F.col("date").isNull() | F.coalesce(F.lag("date", 1).over(by_series(date=position)) >= F.col("date"), F.lit(False)))
        more = [F.count_if("__late").alias("not_increasing")]
    return df.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if("__same").alias("repeated"), F.count_if(F.col("close").isNull() | (F.col("close") <= 0)).alias("bad_close"), F.count_if(F.abs(F.col("mm_long") - F.col("mm_short") - F.col("mm_net")) > 0.001).alias("bad_net"),
        F.count_if(share("mm_pct") | share("oi_pct")).alias("bad_percentile"), F.count_if(F.abs(F.col("__again") - F.col("r1")) > 1e-8).alias("bad_return"), *more,
    )


def validate_cases(stored: DataFrame, df: DataFrame, features: Sequence[str], returns: Mapping[int, str], top: int = 20) -> DataFrame:
    """For each series of df its stored similar cases, and those that differ from cases found anew.

    stored: series_id, date, current_date, score and returns. df: the weekly table with features and
    returns. Counts: cases; of another current date; at a date that df lacks; with returns
    that differ by over 1e-8; without their like (date, and score within 1e-7) among the top cases
    found anew; and of those the ones that are not stored.
    """
    anew = similar_states(df, features, top=top).select("series_id", "date", F.col("score").alias("__score"))
    known = df.select("series_id", "date", F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in returns.values()])
    last = df.groupBy("series_id").agg(F.max("date").alias("__last"))
    rows = stored.select("*", F.lit(True).alias("__stored")).join(anew, ["series_id", "date"], "full_outer").join(known, ["series_id", "date"], "left").join(last, "series_id", "full_outer")
    differs = F.lit(False)
    for c in returns.values():
        differs = differs | ~F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) <= 1e-8, F.lit(False))
    here = F.coalesce("__stored", F.lit(False))
    like = F.coalesce(F.abs(F.col("score") - F.col("__score")) < 1e-7, F.lit(False))
    return rows.groupBy("series_id").agg(
        F.count_if(here).alias("n"), F.count_if(here & ~F.col("current_date").eqNullSafe(F.col("__last"))).alias("other_current"), F.count_if(here & F.col("__known").isNull()).alias("unknown_date"),
        F.count_if(here & differs).alias("bad_return"), F.count_if(here & ~like).alias("not_expected"), F.count_if(F.col("__score").isNotNull() & ~(here & like)).alias("not_stored"),
    )


def validate_summary(summary: DataFrame, df: DataFrame, shares: Mapping[str, str]) -> DataFrame:
    """For each series of df: does its summary record have the date, close (within 0.01) and percentiles (points, within 0.001) of its last row?

    shares: columns of the summary, in points, and those of df, as shares.
    """
    last = df.groupBy("series_id").agg(F.max("date").alias("__date"), *[F.max_by(c, "date").alias(f"__{c}") for c in ("close", *shares.values())])
    near = lambda a, b, most: F.coalesce(F.abs(a - b) <= most, F.lit(False))
    rows = last.join(summary.select("series_id", "date", "close", *shares), "series_id", "left")
    same = F.lit(True)
    for mine, theirs in shares.items():
        same = same & near(F.col(mine), F.col(f"__{theirs}") * 100, 0.001)
    return rows.select("series_id", F.coalesce(F.col("date") == F.col("__date"), F.lit(False)).alias("same_date"), near(F.col("close"), F.col("__close"), 0.01).alias("same_close"), same.alias("same_shares"))


def source_audit(df: DataFrame, source: str = "source", value: str = "close", classes: Sequence[str] = SOURCE_CLASSES) -> DataFrame:
    """For each series: statistics of value; rows and dates of each class of source, classes without rows too; rows of each label as it is written.

    Rows: series_id, section ('stats', 'class', 'label'), item, label, n, first, last and value.
    """
    rows = df.withColumn("__class", source_class(source))
    there = F.col(value).isNotNull()
    ends = [F.min("date").alias("first"), F.max("date").alias("last")]
    stats = df.groupBy("series_id").agg(F.count(value).alias("n"), F.min(F.when(there, F.col("date"))).alias("first"), F.max(F.when(there, F.col("date"))).alias("last"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    stats = stats.select("series_id", "n", "first", "last", F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.col(k).cast("double").alias("value")) for k in ("n", "min", "max", "mean")])).alias("k"))
    none = F.lit(None).cast("string")
    out = stats.select("series_id", F.lit("stats").alias("section"), "k.item", none.alias("label"), "n", "first", "last", "k.value")
    found = rows.groupBy("series_id", F.col("__class").alias("item")).agg(F.count(F.lit(1)).alias("n"), *ends)
    every = df.select("series_id").distinct().withColumn("item", F.explode(F.array(*[F.lit(c) for c in classes])))
    kinds = every.join(found, ["series_id", "item"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.unionByName(kinds.select("series_id", F.lit("class").alias("section"), "item", none.alias("label"), "n", "first", "last", F.col("n").cast("double").alias("value")))
    labels = rows.groupBy("series_id", F.col("__class").alias("item"), F.col(source).alias("label")).agg(F.count(F.lit(1)).alias("n"), *ends)
    return out.unionByName(labels.select("series_id", F.lit("label").alias("section"), "item", "label", "n", "first", "last", F.col("n").cast("double").alias("value")))


def data_health(master: DataFrame, components: Mapping[str, DataFrame], cases: DataFrame, stats: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """For each series of master the state of what was made from it: status, warnings, expected (its last date), the date of each component, stale (components of another date, sorted), rows, cases, statistics.

    components: by name, with series_id and date. cases: series_id and current_date; stats: series_id.
    Missing columns of master make an error everywhere, a series without any date too.
    """
    absent = sorted(set(required) - set(master.columns))
    one = master.groupBy("series_id").agg(F.max("date").alias("expected"), F.count(F.lit(1)).alias("master_rows"))
    seen = None
    for name, df in components.items():
        part = df.select("series_id", F.lit(name).alias("__c"), "date")
        seen = part if seen is None else seen.unionByName(part)
    dates = seen.groupBy("series_id", "__c").agg(F.max("date").alias("date")).groupBy("series_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__c", "date")))).alias("__dates"))
    own = cases.groupBy("series_id").agg(F.count(F.lit(1)).alias("cases"), F.max("current_date").alias("case_date"))
    rows = one.join(dates, "series_id", "left").join(own, "series_id", "left").join(stats.groupBy("series_id").agg(F.count(F.lit(1)).alias("stats_rows")), "series_id", "left")
    at = lambda n: F.try_element_at("__dates", F.lit(n))
    named = {n: at(n) for n in components} | {"cases": F.col("case_date")}
    stale = F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(d == F.col("expected"), F.lit(False)), n) for n, d in named.items()])))
    rows = rows.withColumns({"stale": stale, "cases": F.coalesce("cases", F.lit(0)), "stats_rows": F.coalesce("stats_rows", F.lit(0)), "component_dates": F.create_map(*[x for n, d in named.items() for x in (F.lit(n), d)])})
    warnings = [
        F.when(F.lit(bool(absent)), "missing_master_columns"), F.when(F.col("case_date").isNotNull() & (F.col("case_date") != F.col("expected")), "case_date_mismatch"),
        F.when(F.size("stale") > 0, "stale_components"), F.when(F.col("cases") == 0, "cases_empty"), F.when(F.col("stats_rows") == 0, "case_stats_empty"),
    ]
    broken = F.lit(bool(absent)) | F.col("expected").isNull()
    status = F.when(broken, "error").when(F.size("stale") > 0, "partial_stale").otherwise("ok")
    return rows.select("series_id", status.alias("status"), F.upper(status).alias("overall"), F.array_compact(F.array(*warnings)).alias("warnings"), "expected", "component_dates", "stale", "master_rows", "cases", "stats_rows", F.array(*[F.lit(c) for c in absent]).cast("array<string>").alias("missing_columns"))


def validate_outcomes(df: DataFrame) -> DataFrame:
    """For each series the outcomes, and those that break a rule."""
    week = F.date_add(F.date_trunc("week", "report_date").cast("date"), 7)
    bounds = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close"))
    ratio = F.abs(F.col("change_pct") * F.col("open") - F.col("change")) > 1e-8 * F.greatest(F.lit(1.0), F.abs("open"))
    return df.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(F.col("week_start") != week).alias("wrong_week"), F.count_if(F.col("pending") & F.col("close").isNotNull()).alias("pending_with_prices"), F.count_if(bounds).alias("bad_bounds"), F.count_if(ratio).alias("bad_ratio"))


def history_coverage(reports: DataFrame, prices: DataFrame) -> DataFrame:
    """For each series: do prices begin before the first outcome week and reach the last report?"""
    a = reports.groupBy("series_id").agg(F.min("date").alias("__a"), F.max("date").alias("__b"))
    b = prices.groupBy("series_id").agg(F.min("date").alias("first_price"), F.max("date").alias("last_price"))
    first_week = F.date_add(F.date_trunc("week", "__a").cast("date"), 7)
    return a.join(b, "series_id", "left").select("series_id", "first_price", "last_price", (F.col("first_price") <= first_week).alias("starts_in_time"), (F.col("last_price") >= F.col("__b")).alias("reaches_end"))


def release_errors(sources: DataFrame, now: str, most_hours: float = 36.0) -> DataFrame:
    """sources with errors: a check older than most_hours or in the future, a file that differs from the verified one, no observation date; or that there is no check or no file.

    sources: name, fetched_at, observed, sha256 (of the verified download) and file_sha256.
    """
    age = (F.lit(now).cast("timestamp").cast("double") - F.col("fetched_at").cast("timestamp").cast("double")) / 3600
    old = F.when((age > most_hours) | (age < -0.1), "check is not recent")
    unknown = F.lit("check is missing or invalid")
    differs = F.when(~F.coalesce(F.col("sha256") == F.col("file_sha256"), F.lit(False)), "file differs")
    # a check that cannot be read is one error, and nothing after it is looked at
    found = F.when(age.isNull(), F.array(unknown)).when(F.col("file_sha256").isNull(), F.array(old, unknown)).otherwise(F.array(old, differs, F.when(F.col("observed").isNull(), "observation date is missing")))
    return sources.withColumn("errors", F.array_compact(found))


def normal_observation(now: str) -> Column:
    """The Tuesday whose report the timetable (Friday 15:30 in New York) has out by now."""
    local = F.from_utc_timestamp(F.lit(now).cast("timestamp"), NEW_YORK)
    today = F.to_date(local)
    friday = F.date_sub(today, F.pmod(F.weekday(today) - 4, F.lit(7)))
    early = (F.weekday(today) == 4) & (F.date_format(local, "HH:mm") < "15:30")
    return F.date_sub(F.when(early, F.date_sub(friday, 7)).otherwise(friday), 3)


def release_status(components: DataFrame, sources: DataFrame, now: str, report: str, hub: str, master: str = "master") -> DataFrame:
    """One row with status, n_errors, stale (components but the master, sorted), observed and normal.

    SOURCE_UNVERIFIED where a source has errors; else ERROR where a component has no
    date at all, STALE where the hub is not current, PARTIAL_STALE where another one is
    not; AWAITING_RELEASE where all are but the report of the timetable is not out.
    components: component, latest and current; both tables are a few rows.
    """
    named = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("component"))))
    a = components.agg(F.count_if(F.col("latest").isNull()).alias("lost"), F.count_if((F.col("component") == hub) & ~F.col("current")).alias("hub"), named(~F.col("current") & (F.col("component") != master)).alias("stale"), F.count_if(~F.col("current")).alias("old")).withColumn("__i", F.lit(1))
    b = release_errors(sources, now).agg(F.sum(F.size("errors")).alias("n_errors"), F.max(F.when(F.col("name") == report, F.col("observed"))).alias("observed")).withColumn("__i", F.lit(1))
    one = a.join(b, "__i").withColumn("normal", normal_observation(now))
    state = (
        F.when(F.coalesce("n_errors", F.lit(0)) > 0, "SOURCE_UNVERIFIED").when(F.col("lost") > 0, "ERROR").when(F.col("hub") > 0, "STALE").when(F.col("old") > 0, "PARTIAL_STALE")
        .when(F.col("observed") < F.col("normal"), "AWAITING_RELEASE").otherwise("OK")
    )
    return one.select(state.alias("status"), F.coalesce("n_errors", F.lit(0)).cast("long").alias("n_errors"), "stale", "observed", "normal")


def outcome_rules(df: DataFrame, reports: DataFrame) -> DataFrame:
    """For each series its outcomes, and those whose date is unknown or repeated, whose week has no result yet but prices, that are complete without prices, whose eligibility lacks evidence, or that have an hour where only the day of an extreme is known.

    Evidence is a source, and a release time that is not after the week's opening or a publication date before it; the
    status alone proves nothing. df: outcomes with status and eligible (availability), opens, actual_ts, actual_date,
    revision_risk and has_source; reports: series_id and report_date.
    """
    known = reports.select("series_id", "report_date").distinct().withColumn("__known", F.lit(True))
    w = Window.partitionBy("series_id", "report_date")
    rows = df.join(known, ["series_id", "report_date"], "left").withColumn("__n", F.count("*").over(w))
    prices = ("open", "high", "low", "close")
    some = F.coalesce(*[F.col(c) for c in (*prices, "change", "range")]).isNotNull() | F.coalesce("high_date", "low_date").isNotNull()
    sound = F.lit(True)
    for c in prices:
        sound = sound & F.coalesce(F.col(c) > 0, F.lit(False))
    by_date = (F.col("status") == "ACTUAL_PUBLICATION_DATE_BEFORE_WEEK_START") & F.col("actual_date").isNotNull()
    proven = F.coalesce("has_source", F.lit(False)) & (F.coalesce(F.col("actual_ts") <= F.col("opens"), F.lit(False)) | F.coalesce(by_date, F.lit(False)))
    loose = F.lit(False)
    for side in ("high", "low"):
        loose = loose | (F.col(f"{side}_start").isNotNull() & ~F.coalesce(F.col(f"{side}_reason").startswith("MATCHED"), F.lit(False)))
    return rows.groupBy("series_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("__known").isNull()).alias("unknown_date"), F.count_if(F.col("__n") > 1).alias("repeated_date"), F.count_if((F.col("coverage") == "PENDING") & some).alias("pending_with_results"),
        F.count_if((F.col("coverage") == "COMPLETE_DAILY") & ~sound).alias("complete_without_prices"), F.count_if(F.col("eligible") & ~proven).alias("eligible_without_evidence"),
        F.count_if(F.col("eligible") & F.coalesce("revision_risk", F.lit(False))).alias("risky_but_eligible"), F.count_if(F.col("status").contains("_AFTER_") & F.coalesce("eligible", F.lit(True))).alias("late_but_not_excluded"),
        F.count_if(loose).alias("hour_without_match"),
    )


def foreign_rows(prices: DataFrame, feed: str) -> DataFrame:
    """For each series the rows whose source does not name the feed, and whether its history may be used: rows, and none of them foreign."""
    foreign = ~F.coalesce(F.col("source").contains(feed), F.lit(False))
    return prices.groupBy("series_id").agg(F.count("*").alias("n"), F.count_if(foreign).alias("n_foreign")).withColumn("usable", F.col("n_foreign") == 0)
