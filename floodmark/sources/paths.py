"""Where intermediate files go: the shared folder of the cluster. Writes that carry their own checks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; on one machine a temporary folder where that is unset (tests)."""
    key = "spark.checkpoint.dir"
    base = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{key} must name a folder that all machines share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set(key, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that several uses compute it once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Removes the tables of scratch that frames read, once what was made of them is written."""
    for folder in {f.rpartition("/")[0] for df in frames for f in df.inputFiles()}:
        if re.search(r"-[0-9a-f]{32}$", folder):
            remove(frames[0].sparkSession, folder)


def hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path and the path, as Hadoop knows them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


class ChecksFailed(ValueError):
    """A write that was not published. counts: rows that each check found."""

    def __init__(self, message: str, counts: Mapping[str, int]) -> None:
        super().__init__(message)
        self.counts = dict(counts)


def write_observed(df: DataFrame, path: str, checks: Mapping[str, Column], *, by: Sequence[str] = (), told: Column | None = None, drop: Sequence[str] = ()) -> dict[str, Any]:
    """Writes df without the columns in drop and counts, in the same pass, the rows for which each check holds.

    Gives the counts by name, ``rows``, and with told its smallest and largest text
    (``first``, ``last``) among rows that a check finds.
    """
    seen = Observation()
    any_bad = F.lit(False)
    for c in checks.values():
        any_bad = any_bad | F.coalesce(c, F.lit(False))
    metrics = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()]]
    if told is not None:
        metrics += [F.min(F.when(any_bad, told)).alias("first"), F.max(F.when(any_bad, told)).alias("last")]
    out = df.observe(seen, *metrics).drop(*drop).write
    (out.partitionBy(*by) if by else out).parquet(path)
    return seen.get


def write_checked(df: DataFrame, path: str, checks: Mapping[str, Column], *, by: Sequence[str] = (), told: Column | None = None, message: str = "rows rejected", drop: Sequence[str] = ()) -> dict[str, Any]:
    """write_observed beside path, and a rename to path if no check finds a row; else what was written goes, and ChecksFailed says how many and which."""
    spark = df.sparkSession
    beside = f"{path}-unchecked-{uuid.uuid4().hex}"
    counts = write_observed(df, beside, checks, by=by, told=told, drop=drop)
    found = {n: counts[n] for n in checks if counts[n]}
    if found:
        remove(spark, beside)
        named = "" if told is None else f" ({counts['first']} to {counts['last']})"
        raise ChecksFailed(f"{message}: " + ", ".join(f"{n} {k}" for n, k in found.items()) + named, found)
    fs, source = hadoop(spark, beside)
    if not fs.rename(source, hadoop(spark, path)[1]):
        raise OSError(f"{path} could not be published")
    return counts


def stored_checked(df: DataFrame, name: str, checks: Mapping[str, Column], *, told: Column | None = None, message: str = "rows rejected", drop: Sequence[str] = ()) -> DataFrame:
    """stored, if no check finds a row: df is planned and run once for its checks and its rows. Columns in drop serve the checks only."""
    path = scratch(df.sparkSession, name)
    write_checked(df, path, checks, told=told, message=message, drop=drop)
    return df.sparkSession.read.schema(df.drop(*drop).schema).parquet(path)
