"""WARC records and a Merkle audit of replicas.

A record's leaf is the hash of its bytes with its place: archive, number, offset
and length. ``FANOUT`` nodes in order make a node above, up to one root for each
archive. Replicas are compared root by root; only below nodes that differ are the
children compared, down to the records.

Defined results: null urls and bodies count as empty; a null archive is the one
without a name (``""``), null ids come first in their archive; repeated records are
records of their own; a record that one replica lacks, or has at another place, is
named with its place in each. An empty table has no archives and no findings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FANOUT = 16
#: Records in an archive, about.
ARCHIVE_RECORDS = 4096


def record_bytes(url: Column, body: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """A WARC/1.1 resource record."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha256:"), F.sha2(body.cast("binary"), 256), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n")).cast("binary")


def parse_warc(files: DataFrame, *, name_col: str = "path", content_col: str = "content") -> DataFrame:
    """archive, number, offset, length, url and body of the records of whole uncompressed files (as binaryFile reads them).

    A record whose head cannot be read ends its file with a row of null url and body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, rows = 0, []
                data = data or b""
                while at < len(data):
                    end = data.find(b"\r\n\r\n", at)
                    fields = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:] if b": " in x) if end >= 0 else {}
                    size = fields.get(b"Content-Length", b"")
                    if not size.isdigit():
                        rows.append((name, len(rows), at, len(data) - at, None, None))
                        break
                    stop = end + 4 + int(size)
                    rows.append((name, len(rows), at, stop + 4 - at, fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace"), data[end + 4 : stop]))
                    at = stop + 4
                types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=["archive", "number", "offset", "length", "url", "body"])

    return files.select(name_col, content_col).mapInArrow(run, "archive string, number long, offset long, length long, url string, body binary")


def placed_leaves(records: DataFrame, *, id_col: str, archive: Column, bytes_: Column) -> DataFrame:
    """archive, number, offset, length, id and hash of each record, in the order of its id within its archive.

    Bytes are hashed before anything is shuffled; only narrow rows move.
    """
    rows = records.select(F.col(id_col).alias("id"), F.coalesce(archive, F.lit("")).alias("archive"), F.octet_length(bytes_).cast("long").alias("length"), F.sha2(bytes_, 256).alias("digest"))
    w = Window.partitionBy("archive").orderBy("id", "digest")
    rows = rows.withColumn("number", F.row_number().over(w).cast("long") - 1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    place = F.concat_ws(":", "archive", "number", "offset", "length", "digest")
    return rows.withColumn("hash", F.sha2(place.cast("binary"), 256))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes above: archive, number, hash. nodes has archive, number and hash; a parent has at most fanout children."""
    below = F.array_sort(F.collect_list(F.struct("number", "hash")))
    up = nodes.groupBy("archive", F.floor(F.col("number") / fanout).alias("up")).agg(below.alias("c"))
    return up.select("archive", F.col("up").alias("number"), F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), "").cast("binary"), 256).alias("hash"))


def merkle_levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels of the trees, leaves first, one root for each archive last."""
    levels = [leaves]
    size = leaves.agg(F.max("number")).first()[0]
    size = 1 if size is None else size + 1
    while size > 1:
        levels.append(stored(parents(levels[-1].select("archive", "number", "hash"), fanout), "merkle"))
        size = -(-size // fanout)
    return levels


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records in which two replicas differ, by descending from the roots.

    first and second: placed_leaves of each. Gives archive, number, and of each
    replica (a_, b_) id, offset, length and digest, null where it has no such record.
    """
    one, two = merkle_levels(first, fanout), merkle_levels(second, fanout)
    depth = max(len(one), len(two))
    one += [one[-1].select("archive", "number", "hash")] * (depth - len(one))
    two += [two[-1].select("archive", "number", "hash")] * (depth - len(two))
    suspect: DataFrame | None = None
    for level in range(depth - 1, -1, -1):
        a, b = (x[level].select("archive", "number", "hash") for x in (one, two))
        if suspect is not None:
            a, b = (x.withColumn("up", F.floor(F.col("number") / fanout)).join(suspect, ["archive", "up"], "left_semi").drop("up") for x in (a, b))
        both = a.withColumnRenamed("hash", "x").join(b.withColumnRenamed("hash", "y"), ["archive", "number"], "full_outer")
        bad = both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("archive", "number")
        if level:
            suspect = stored(bad.withColumnRenamed("number", "up"), "suspects")
        else:
            side = lambda df, p: df.select("archive", "number", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "offset", "length", "digest")])
            return bad.join(side(first, "a"), ["archive", "number"], "left").join(side(second, "b"), ["archive", "number"], "left")
    raise AssertionError
