"""Shards of nearly equal bytes by longest processing time: the largest group goes first, each to the shard with the least.

Documents of equal texts are a group and stay together. Groups of at least one
BUNDLES-th of all bytes are items of their own (so there are BUNDLES at most);
smaller groups go by their digest into BUNDLES bundles, each an item. These items,
a bounded number whatever the size of the table, are sorted by size and taken from
the front; a heap of the 16 loads names the shard. While groups are larger than that
share the result is the schedule over the groups themselves; beyond, a
bundle is a few groups that stay together. Loads differ by the size of the smallest
items, or by a group that is larger than a fair share. The table itself never moves
for this: rows find their shard by the two small tables.

Defined results: a null text counts as an empty one, both are one group; items of equal
size are ordered by kind (groups first) and key; an empty table gives an empty one; rows
with equal ids are told apart by their text; extra columns with any names pass through
``write_shards``.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .order import numbered

SHARDS = 16
#: Share of all bytes from which on a group is an item of its own, as one of so many; and the number of bundles. Rows that reach the driver: twice that at most.
BUNDLES = 16384


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one more (for what ends a document)."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def bundle_of(digest: Column, bundles: int = BUNDLES) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % bundles


def schedule(items: list[tuple], shards: int = SHARDS) -> list[tuple[int, tuple]]:
    """(shard, item) of items (size, kind, key): the largest first, each to the shard with the least, the lowest number among equals."""
    loads = [(0, k) for k in range(shards)]
    out = []
    for item in sorted(items, key=lambda x: (-x[0], *x[1:])):
        load, k = loads[0]
        heapq.heapreplace(loads, (load + item[0], k))
        out.append((k, item))
    return out


def assign_groups(rows: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES) -> tuple[DataFrame, DataFrame]:
    """The shard of each large group (digest, shard) and of each bundle (bundle, shard). rows: digest, size.

    Sizes are summed before anything is shuffled, so copies of one text are one row a task.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    large = F.col("size") * bundles >= total
    some = groups.filter(large).select("size", F.lit(0).alias("kind"), F.col("digest").alias("key"))
    rest = groups.filter(~large).groupBy(bundle_of(F.col("digest"), bundles).alias("b")).agg(F.sum("size").alias("size"))
    # at most 2 * bundles rows
    items = [tuple(r) for r in some.unionByName(rest.select("size", F.lit(1).alias("kind"), F.lpad(F.col("b").cast("string"), 10, "0").alias("key"))).collect()]
    drop_stored(groups)
    done = schedule(items, shards)
    one = spark.createDataFrame([(key, k) for k, (_, kind, key) in done if kind == 0], "digest string, shard int")
    two = spark.createDataFrame([(int(key), k) for k, (_, kind, key) in done if kind == 1], "bundle long, shard int")
    return one, two


def _placed(rows: DataFrame, maps: tuple[DataFrame, DataFrame], bundles: int) -> DataFrame:
    """rows (digest, ...) with their shard. Both maps have at most bundles rows."""
    one, two = maps
    found = rows.withColumn("bundle", bundle_of(F.col("digest"), bundles)).join(F.broadcast(one), "digest", "left").join(F.broadcast(two.withColumnRenamed("shard", "other")), "bundle", "left")
    return found.withColumn("shard", F.coalesce("shard", "other")).drop("bundle", "other")


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """id, size, text_crc32, digest, shard and slot (from 0, without gaps, in the order of ids) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), text_size(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_digest(text).alias("digest")), "sizes")
    return numbered(_placed(rows, assign_groups(rows, shards, bundles), bundles), ["shard"], ["id", "digest"], "slot")


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bundles: int = BUNDLES, files: int = 8) -> DataFrame:
    """Writes whole rows as Parquet, a folder for each shard and about so many files in each; returns shard, rows and bytes of each.

    Rows of a shard are dealt over its files by the hash of their text, in the order of ids within a file.
    """
    digest = text_digest(F.col(text_col))
    maps = assign_groups(docs.select(digest.alias("digest"), text_size(F.col(text_col)).alias("size")), shards, bundles)
    # the row goes as one column, so that no column of docs has the name of a result
    rows = _placed(docs.select(F.struct("*").alias("row"), digest.alias("digest"), text_size(F.col(text_col)).alias("size")), maps, bundles)
    rows = rows.withColumn("file", F.pmod(F.xxhash64("digest", f"row.{id_col}"), F.lit(files)))
    rows.repartition(shards * files, "shard", "file").sortWithinPartitions("shard", F.col(f"row.{id_col}")).select("shard", "row", "size").write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.schema("size long, shard int").parquet(path)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
