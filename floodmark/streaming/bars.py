"""Bars from a stream of ticks, and upserts of bars from a stream of refreshes."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.clean import bar_reason
from ..sources.paths import scratch
from ..sources.versions import Versions

_MINUTE, _HOUR = 60_000_000, 3_600_000_000  # in microseconds


def tick_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes", *, series: str = "event_type", ts: str = "ts", price: str = "value", order: str = "event_id") -> DataFrame:
    """Tumbling bars of a stream. In append mode a bar comes out once it is over for good: when the watermark passes its end; later ticks are dropped."""
    place = F.struct(ts, order)
    bars = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.col(series).alias("series_id"), F.window(ts, width).alias("w")).agg(
        F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, place).alias("close"), F.count("*").alias("volume"),
    )
    return bars.select("series_id", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "volume")


def replay_bars(spark: SparkSession, path: str) -> DataFrame:
    """All closed hourly bars of a table of events, read as a stream; the result is the stream's output table."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", name if name.endswith(".parquet") else "*").parquet(folder if not _is_folder(spark, path) else path)
    out, state = scratch(spark, "stream-bars"), scratch(spark, "stream-state")
    run = tick_bars(ticks).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("series_id string, bar_start timestamp, open double, high double, low double, close double, volume long").parquet(out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


class _BarEnds(StatefulProcessor):
    """Holds the stamps of a series until the watermark has passed the end of their bars. One timer a series, at the earliest end that is open."""

    def __init__(self, request_end: int) -> None:
        self.request_end = request_end

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "stamp long")

    def _ends(self, stamps: list[int]) -> Iterator[tuple[int, int]]:
        """(stamp, end) of stamps in descending order: an hour on, the end of the request, or the next stamp on a minute."""
        after = None
        for t in reversed(stamps):
            end = min(t + _HOUR, self.request_end)
            yield t, end if after is None else min(end, after)
            if t % _MINUTE == 0:
                after = t

    def _keep(self, stamps: list[int], watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.clear()
        if stamps:
            self.open.put([(t,) for t in stamps])
            # a timer before the watermark would never fire
            self.handle.registerTimer(max(min(end for _, end in self._ends(stamps)) // 1000, watermark) + 1)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        stamps = {t[0] for t in self.open.get()} if self.open.exists() else set()
        for part in rows:
            stamps |= set(part["stamp"].tolist())
        self._keep(sorted(stamps), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        past = timerValues.getCurrentWatermarkInMs() * 1000
        stamps = sorted(t[0] for t in self.open.get())
        done = [(t, end) for t, end in self._ends(stamps) if end <= past and t < past]
        gone = {t for t, _ in done}
        self._keep([t for t in stamps if t not in gone], past // 1000)
        if done:
            yield pd.DataFrame({"series_id": [key[0]] * len(done), "stamp": [t for t, _ in done], "end": [e for _, e in done]})

    def close(self) -> None:
        pass


def stream_bar_ends(ticks: DataFrame, request_end: str, late: str = "10 minutes", *, series: str = "event_type", ts: str = "ts") -> DataFrame:
    """clean.bar_end on a stream: series_id, ts and bar_end of each distinct stamp, once the watermark has passed that end.

    A stamp's end is known when a later stamp on a minute or its hour is past for good; until then it
    stands in the state of its series, which holds about an hour of stamps. Stamps whose end the watermark has not reached stay there.
    """
    end = int(dt.datetime.fromisoformat(request_end).replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    rows = ticks.select(F.col(series).alias("series_id"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late).withColumn("stamp", F.unix_micros("ts"))
    found = rows.groupBy("series_id").transformWithStateInPandas(_BarEnds(end), "series_id string, stamp long, end long", "Append", "EventTime")
    return found.select("series_id", F.timestamp_micros("stamp").alias("ts"), F.timestamp_micros("end").alias("bar_end"))


def replay_bar_ends(spark: SparkSession, path: str, request_end: str, files: int = 1000) -> DataFrame:
    """stream_bar_ends over a folder of stamps (series_id, ts), so many files a batch, read as a stream to its end; the result is the stream's output table."""
    provider = "spark.sql.streaming.stateStore.providerClass"  # list state and timers need RocksDB
    before = spark.conf.get(provider)
    out, state = scratch(spark, "stream-ends"), scratch(spark, "stream-state")
    feed = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        ends = stream_bar_ends(feed, request_end, series="series_id")
        run = ends.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("series_id string, ts timestamp, bar_end timestamp").parquet(out)


def bar_table(spark: SparkSession, root: str, keys: Sequence[str] = ("series_id", "date")) -> Versions:
    """A table of daily bars in committed versions, a folder for each month; bars without a good price are not accepted."""
    return Versions(spark, root, keys, reason=bar_reason())


def upsert_into(root: str, *, keys: Sequence[str] = ("series_id", "date"), source: str = "stream", whole: bool = False, unit: Sequence[str] = ()):
    """For foreachBatch: merges each batch's good bars into the table at root and publishes a version; rejects stand aside.

    With whole=True a batch that holds a bad bar or a key twice is rejected as a whole; with
    unit, what shares these columns with such a bar is (a delivery, whatever batch it comes in).
    A batch that runs again after a failure is known by its number, also after compaction.
    """

    def apply(batch: DataFrame, number: int) -> None:
        bar_table(batch.sparkSession, root, keys).merge(batch, batch=number, source=source, whole=whole, unit=unit)

    return apply


def current(spark: SparkSession, root: str, keys: Sequence[str] = ("series_id", "date")) -> DataFrame:
    """The bars of the latest version."""
    return bar_table(spark, root, keys).read()


def compact(spark: SparkSession, root: str, keys: Sequence[str] = ("series_id", "date")) -> int:
    """Fewer and sorted files as a new version, in place; gives its number. The stream may go on, or run its last batch again."""
    return bar_table(spark, root, keys).compact()["number"]


def replay_upserts(spark: SparkSession, path: str, *, unit: Sequence[str] = (), files: int = 4) -> DataFrame:
    """A folder of refreshed bars as a stream of upserts; the bars that stand at its end, after compaction."""
    feed = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    root, state = scratch(spark, "bar-table"), scratch(spark, "stream-state")
    run = feed.writeStream.foreachBatch(upsert_into(root, unit=unit)).option("checkpointLocation", state).trigger(availableNow=True).start()
    run.awaitTermination()
    compact(spark, root)
    return current(spark, root)
