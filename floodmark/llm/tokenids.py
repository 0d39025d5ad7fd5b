"""Token ids of all documents in blocks of canonical Huffman code, and their reading.

The file format is a folder of Parquet files with one row per block, in which
documents stand whole and in ascending order of their id:

    shard, block        order of the blocks
    start_in_shard      ids of the shard before this block
    doc_ids, doc_tokens the documents and their numbers of ids
    n_tokens, bits      the ids of the block and their code
    checkpoints         little-endian 64-bit bit offsets, one for each 128 ids

beside a folder ``code`` with the length of each id's code and a folder ``shards``
with the ids of each shard. A block can be decoded alone, and so can a stretch of
it from its checkpoint.

Defined results: a null text counts as empty and holds the end id alone; null ids
of documents come first; documents of one id stand in the order of their ids'
bytes; an empty table gives no blocks. Extra columns are not stored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches
from .huffman import Code, code_lengths
from .pieces import CACHE_BYTES, SPACE, TextCoder, binaries, chunks, gather

#: Pieces that go through the library as one text.
JOINED = 2000
#: Ids in a block, of several documents at least.
BLOCK_IDS = 1 << 18
#: Bits of a code at most.
LIMIT = 20


class LibraryEncoder:
    """Texts to ids with the tokenizers library, each distinct piece of them once.

    added: texts that hold an added token of the file (``<|endoftext|>``) go through
    the library whole, as it was loaded; otherwise such a token counts as plain text.
    """

    def __init__(self, path: str, added: bool = False):
        self.path, self.added = path, added
        self._ready = False

    def __getstate__(self):
        return {"path": self.path, "added": self.added, "_ready": False}

    def _prepare(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = self.tok = Tokenizer.from_file(self.path)
        tok.encode_special_tokens = True  # the pieces below hold no added token that counts
        contents = [t.content for t in tok.get_added_tokens_decoder().values()] if self.added else []
        self.untouched = Tokenizer.from_file(self.path) if contents else None
        self.marks = contents
        vocabulary = tok.get_vocab()
        self.width = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        #: Ids whose bytes begin with a blank, and those of a line break: they part the pieces that are encoded as one text.
        self.opens, self.breaks = (np.zeros(max(vocabulary.values()) + 1, bool) for _ in range(2))
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.breaks[self._ids("\n")] = True
        self.coder = TextCoder(self._pieces, 2 * CACHE_BYTES)  # the library is slow beside the cache
        self._ready = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)

    def _parted(self, pieces: list[str], sign: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and sizes of pieces that begin with a blank (sign ""), or hold no white space (a line break as sign), many as one text."""
        ids, sizes = [], []
        for a in range(0, len(pieces), JOINED):
            part = pieces[a : a + JOINED]
            v = self._ids(sign.join(part))
            if sign:
                between = self.breaks[v]
                ends = np.append(np.flatnonzero(between) - np.arange(np.count_nonzero(between)), len(v) - np.count_nonzero(between))
                v = v[~between]
            else:
                ends = np.append(np.flatnonzero(self.opens[v])[1:], len(v))
            if len(ends) != len(part):  # the vocabulary has no such sign of its own
                own = [self._ids(p) for p in part]
                v, ends = np.concatenate(own), np.cumsum([len(x) for x in own])
            ids.append(v)
            sizes.append(np.diff(ends, prepend=0))
        return ids, sizes

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        kinds: tuple[list[int], list[int], list[int]] = ([], [], [])
        blank = frozenset(SPACE)
        for i, p in enumerate(pieces):
            kinds[2 if p[-1] in blank else 0 if p[0] == " " else 1].append(i)
        sizes = np.zeros(len(pieces), np.int64)
        ids: list[np.ndarray] = []
        for kind, sign in ((0, ""), (1, "\n")):
            v, n = self._parted([pieces[i] for i in kinds[kind]], sign)
            ids += v
            if n:
                sizes[kinds[kind]] = np.concatenate(n)
        for i in kinds[2]:
            ids.append(self._ids(pieces[i]))
            sizes[i] = len(ids[-1])
        order = np.array([*kinds[0], *kinds[1], *kinds[2]], np.int64)
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return gather(np.concatenate(ids), starts, sizes), sizes

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each chunk of texts their ids, one text after the other, and where each is over."""
        if not self._ready:
            self._prepare()
        for _, part in chunks(texts):
            given = {}
            for mark in self.marks:
                for i in np.flatnonzero(pc.match_substring(part, mark).to_numpy(zero_copy_only=False)).tolist():
                    given[i] = np.array(self.untouched.encode(part[i].as_py(), add_special_tokens=False).ids, self.width)
            ids, ends = self.coder.encode(part, given)
            yield ids.astype(self.width, copy=False), ends


def _closed(ids: np.ndarray, ends: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """ids with end_id after each text, and where each text is then over."""
    if end_id is None:
        return ids, ends
    ends = ends + np.arange(1, len(ends) + 1)
    out = np.full(len(ids) + len(ends), end_id, ids.dtype if end_id <= np.iinfo(ids.dtype).max else "<u4")
    place = np.ones(len(out), bool)
    place[ends - 1] = False
    out[place] = ids
    return out, ends


def tokenize(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, added: bool = False) -> DataFrame:
    """id_col, ids (little-endian unsigned integers of size bytes, with end_id after each document), and size.

    After the documents of a task follows one row with null ids, whose counts hold
    the task's ids and how often each occurs (pairs of little-endian 64-bit integers).
    """
    shared = docs.sparkSession.sparkContext.broadcast(LibraryEncoder(path, added))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        id_type = None
        for batch in small_batches(batches, 10_000):
            id_type = batch.schema.types[0]
            at = 0
            for own in shared.value.encode(batch.column(1)):
                ids, ends = _closed(*own, end_id)
                n = np.bincount(ids, minlength=len(total))
                n[: len(total)] += total
                total = n
                rows = len(ends)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), binaries(ids, ends), pa.array(np.full(rows, ids.itemsize, np.int32)), pa.nulls(rows, pa.binary())], names=names)
                at += rows
        if id_type is not None:
            used = np.flatnonzero(total)
            counts = np.column_stack([used, total[used]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([counts], pa.binary())], names=names)

    names = [id_col, "ids", "size", "counts"]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, size int, counts binary")


def count_ids(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs: the tasks' counts summed; as many rows as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 10_000):
            for x in batch.column(0).to_pylist():
                pairs = np.frombuffer(x, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "n"])

    counts = tokens.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counts.collect()}


def write_token_file(docs: DataFrame, vocabulary: str, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, block_ids: int = BLOCK_IDS, limit: int = LIMIT, added: bool = False) -> None:
    """Encodes docs and writes path. One shuffle, of the coded ids, by ranges of id_col."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    coded = tokenize(docs, vocabulary, id_col=id_col, text_col=text_col, end_id=end_id, added=added)
    coded.write.option("compression", "zstd").parquet(f"{path}/ids")
    made = spark.read.schema(coded.schema).parquet(f"{path}/ids")
    counts = count_ids(made)
    total = np.zeros(max(counts, default=-1) + 1, np.int64)
    total[list(counts)] = list(counts.values())
    code = Code(code_lengths(total, limit))
    lengths = [(int(i), int(n)) for i, n in enumerate(code.lengths) if n]
    spark.createDataFrame(lengths, "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast(code)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            all_ids = np.concatenate([v for _, v in held]) if held else np.zeros(0, np.int64)
            bits, marks = shared.value.encode(all_ids.astype(np.int64))
            row = [shard, block, before, [d for d, _ in held], [len(v) for _, v in held], len(all_ids), bits, marks.astype("<i8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)

        for batch in small_batches(batches, 10_000):
            if not held and not block:
                types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(batch.schema.types[0]), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            for d, x, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((d, np.frombuffer(x, "<u2" if n == 2 else "<u4")))
                size += len(held[-1][1])
                if size >= block_ids:
                    yield close()
                    block, before, size, held = block + 1, before + size, 0, []
        if held:
            yield close()

    names = ["shard", "block", "start_in_shard", "doc_ids", "doc_tokens", "n_tokens", "bits", "checkpoints"]
    schema = f"shard int, block int, start_in_shard long, doc_ids array<{kind}>, doc_tokens array<long>, n_tokens long, bits binary, checkpoints binary"
    ordered = made.filter("ids is not null").select(id_col, "ids", "size").repartitionByRange(id_col).sortWithinPartitions(id_col, "ids")
    ordered.mapInArrow(blocks, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    blocks_made = spark.read.schema(schema).parquet(f"{path}/blocks")
    blocks_made.groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{path}/shards")


def read_token_file(spark: SparkSession, path: str, *, id_type: str = "bigint", id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """One row per document: id_col, start (ids of all documents before it), n_tokens, ids (or their crc32 as ids_crc32)."""
    lengths = spark.read.schema("id long, bits int").parquet(f"{path}/code").collect()  # bounded by the vocabulary
    sizes = np.zeros(max((r["id"] for r in lengths), default=-1) + 1, np.uint8)
    for r in lengths:
        sizes[r["id"]] = r["bits"]
    base, total = {}, 0
    for r in sorted(spark.read.schema("shard int, n_tokens long").parquet(f"{path}/shards").collect(), key=lambda r: r["shard"]):  # one row per output partition
        base[r["shard"]] = total
        total += r["n_tokens"]
    shared = spark.sparkContext.broadcast((Code(sizes), base))
    value = ("ids_crc32", "long", pa.int64()) if digests else ("ids", "array<int>", pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base = shared.value
        for batch in small_batches(batches, 10_000):
            for row in batch.to_pylist():
                ids = code.decode(row["bits"], row["n_tokens"], np.frombuffer(row["checkpoints"], "<i8"))
                ends = np.cumsum(row["doc_tokens"])
                begins = ends - row["doc_tokens"]
                first = base[row["shard"]] + row["start_in_shard"]
                if digests:
                    own = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                else:
                    own = [ids[a:b].tolist() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(begins + first, pa.int64()), pa.array(row["doc_tokens"], pa.int64()), pa.array(own, value[2])]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", value[0]])

    schema = f"shard int, block int, start_in_shard long, doc_ids array<{id_type}>, doc_tokens array<long>, n_tokens long, bits binary, checkpoints binary"
    return spark.read.schema(schema).parquet(f"{path}/blocks").mapInArrow(run, f"`{id_col}` {id_type}, start long, n_tokens long, {value[0]} {value[1]}")
