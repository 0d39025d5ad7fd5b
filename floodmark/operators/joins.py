"""As-of, event and calendar joins; ranges become equal keys, nothing is crossed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import stored_checked
from .windows import DATE, SERIES, by_series


def asof(left: DataFrame, right: DataFrame, values: Sequence[str], *, tolerance_days: int | None = None, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """left with the values of the last right row of its series on or before its date, and right's date as asof_date.

    One shuffle by series: both sides are laid over each other, and each left row
    takes the last right row before it. Beyond tolerance_days the values are null.
    """
    last = F.struct(F.col(date).alias("d"), *values)
    a = left.select(*series, date, F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(last).schema[0].dataType).alias("__r"), F.lit(1).alias("__side"))
    b = right.select(*series, date, F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), last.alias("__r"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*series).orderBy(date, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    fits = F.lit(True) if tolerance_days is None else F.datediff(F.col(f"__l.{date}"), F.col("__r.d")) <= tolerance_days
    taken = [F.when(fits, F.col(f"__r.{v}")).alias(v) for v in values]
    return found.select("__l.*", *taken, F.when(fits, F.col("__r.d")).alias("asof_date"))


def asof_by_days(left: DataFrame, right: DataFrame, values: Sequence[str], tolerance_days: int, *, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """asof by equal keys for few left rows: each left row asks for every day of its tolerance; large series need no sort."""
    key = "__k"
    days = F.explode_outer(F.sequence(F.date_sub(date, tolerance_days), F.col(date)))
    asked = left.withColumn(key, F.monotonically_increasing_id()).select(*series, key, F.struct(*left.columns).alias("__l"), days.alias("__day"))
    have = right.select(*series, F.col(date).alias("__day"), F.struct(*values).alias("__r"))
    # the row travels with its number, which is given once
    found = asked.join(have, [*series, "__day"], "left").withColumn("__met", F.when(F.col("__r").isNotNull(), F.col("__day")))
    best = found.groupBy(key).agg(F.first("__l").alias("__l"), F.max_by("__r", "__met").alias("__r"), F.max("__met").alias("asof_date"))
    return best.select("__l.*", *[F.col(f"__r.{v}").alias(v) for v in values], "asof_date")


def asof_strict(left: DataFrame, right: DataFrame, values: Sequence[str], tolerance_days: int = 4, **keys) -> DataFrame:
    """asof that fails, naming the first and last, if a left row finds nothing within the tolerance.

    The check rides on the write of the result: the join is planned and run once, and
    nothing is published where it fails.
    """
    out = asof(left, right, values, tolerance_days=tolerance_days, **keys)
    told = F.concat_ws(" ", *[F.col(c).cast("string") for c in (*keys.get("series", SERIES), keys.get("date", DATE))])
    return stored_checked(out, "asof-strict", {"unmatched": F.col("asof_date").isNull()}, told=told, message="no price within tolerance")


def asof_refused(left: DataFrame, right: DataFrame, values: Sequence[str], tolerance_days: int = 4, *, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """asof of many series at once, each strict on its own: unmatched counts the rows of the series without a value in time, 0 where the series may be used."""
    out = asof(left, right, values, tolerance_days=tolerance_days, series=series, date=date)
    return out.withColumn("unmatched", F.count_if(F.col("asof_date").isNull()).over(Window.partitionBy(*series)))


def event_window(df: DataFrame, events: DataFrame, x: str, before: int = 12, after: int = 12, require_full: bool = False, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """Rows before..after positions around each event, with x as index 100 at the event and complete (no position missing)."""
    w = by_series(series, date)
    rows = df.withColumn("pos", F.row_number().over(w)).select(*series, "pos", F.col(date).alias("at"), x)
    marks = rows.join(events.select(*series, F.col(date).alias("at")).distinct(), [*series, "at"]).select(*series, F.col("at").alias("event_date"), F.col("pos").alias("__p"), F.col(x).alias("__base"))
    asked = marks.select("*", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("pos", F.col("__p") + F.col("offset"))
    out = asked.join(rows, [*series, "pos"]).filter("__base <> 0")
    own = Window.partitionBy(*series, "event_date")
    out = out.withColumn("complete", F.count(x).over(own) == before + after + 1)
    out = out.withColumn("index", F.col(x) / F.col("__base") * 100).select(*series, "event_date", "offset", F.col("at").alias(date), x, "index", "complete")
    return out.filter("complete") if require_full else out


def event_week_bars(bars: DataFrame, events: DataFrame, weeks: int = 1, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """Daily bars, Monday to Friday, of the weeks from weeks before to weeks after each event's week."""
    monday = F.date_trunc("week", F.col(date)).cast("date")
    asked = events.select(*series, F.col(date).alias("event_date"), F.explode(F.transform(F.sequence(F.lit(-weeks), F.lit(weeks)), lambda k: F.struct(k.alias("week_offset"), F.date_add(monday, k * 7).alias("week")))).alias("k")).select(*series, "event_date", "k.*")
    return bars.withColumn("week", monday).filter(F.weekday(date) < 5).join(asked, [*series, "week"])


def next_week(reports: DataFrame, bars: DataFrame, series: Sequence[str] = SERIES, date: str = DATE) -> DataFrame:
    """Each report with the bars of the Monday to Friday after its week; reports without bars stay."""
    from ..functions.columns import next_week_start

    b = bars.filter(F.weekday(date) < 5).withColumn("week_start", F.date_trunc("week", F.col(date)).cast("date")).withColumnRenamed(date, "bar_date")
    return reports.select(*series, F.col(date).alias("report_date"), next_week_start(date).alias("week_start")).join(b, [*series, "week_start"], "left")


def release_join(reports: DataFrame, evidence: DataFrame, key: str = "report_date") -> DataFrame:
    """Left join of publication evidence; a repeated key of evidence is an error."""
    twice = evidence.groupBy(key).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated evidence for {[r[key] for r in twice]}")
    return reports.join(evidence, key, "left")


def differences(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and side: 'missing' (only expected) or 'unexpected' (only observed)."""
    a, b = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    one = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("missing"))
    return one.unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("unexpected")))


def alignment(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys that both tables have, and those that one alone has."""
    a, b = first.select(*keys).distinct().withColumn("a", F.lit(1)), second.select(*keys).distinct().withColumn("b", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"))
