"""What the corpus operators share: table paths, shared scratch, text chunks, keys."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent on one machine (tests) a temporary folder is taken
    and kept for the session; on a cluster it must be set.
    """
    key = "spark.checkpoint.dir"
    base = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{key} must name a folder that all machines share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set(key, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame, keep: Sequence[DataFrame] = ()) -> None:
    """Removes the tables in the shared folder that frames read and that keep does not. For tables whose results are written already."""
    kept = {_folder(f) for k in keep for f in k.inputFiles()}
    for folder in {_folder(f) for df in frames for f in df.inputFiles()} - kept:
        if re.search(r"-[0-9a-f]{32}$", folder):
            spark = frames[0].sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(file: str) -> str:
    return file.rpartition("/")[0]


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """wanted, or wanted with underscores before it until no column has that name."""
    low = {x.lower() for x in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows. After the last one, memory that is free goes back to the system: workers outlive their tasks."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    del batches
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column of a batch, or a field of a struct column (column.field)."""
    at = batch.schema.get_field_index(name)
    if at >= 0:
        return batch.column(at)
    outer, _, inner = name.partition(".")
    return pc.struct_field(batch.column(batch.schema.get_field_index(outer)), inner)


def slices(texts: Sequence, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose characters add up to about limit; one text is never cut."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > begin and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
