"""The prefix trie of many sequences (conversations) with totals of subtrees, by van Emde Boas recursion.

The depths 0 .. 2^J are cut at half depth: every sequence's prefix up to the cut gets a
name, which is the name of a node and the root of a forest below it. Then the upper
trie and all lower forests are cut at half of their own depth, side by side, and so on
down to single turns: J rounds for sequences of less than 2^J turns. The name of a cut is the
hash of the name above it and of the hash of the turns between; hashes of 2, 4, 8
... turns are made from halves beforehand. Totals go the other way: forests of 1, 2, 4
... levels are grafted onto the leaves of the trie above them, and each node that is no
root of a block takes what lies below its block from there.

Everything is rows (sequence, depth) or (node): a sequence of any length is never one
value, and a node that a third of all sequences pass is an aggregate. Rounds and
tables grow with the logarithm of the longest sequence.

Defined results: rows without a sequence id belong to none; a null role or text is an
empty one; turns of one number are ordered by the hash of role and text, so repeated rows
are repeated turns; a sequence without turns ends at the root. An empty table has no node.
Texts of any length are hashed where they are read. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .order import kept_numbered

_PLACE_BITS = 33
#: Ids of one node that stand in one row before they are hashed.
CHUNK = 256
SPACES = r"[^\x20\x09-\x0D]+"


def _hash(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns_of(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """seq, d (from 1), key (a hash of role and text) and words of each turn, in the order of turn, null first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = _hash(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("seq"), F.col(turn_col).alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(SPACES)).cast("long").alias("words"))
    return kept_numbered(rows, ["seq"], ["turn", "key"], "at").select("seq", (F.col("at") + 1).alias("d"), "key", "words")


def graft_heads(turns: DataFrame, *, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths (seq, n) of sequences whose first h turns are replaced by those of sequence seq - seq % every; h = crc32(seq) % (most + 1).

    If that sequence is shorter, its turns are all; if there is none, nothing stands in
    their place. A sequence of every * k is itself its head.
    """
    own = turns.groupBy("seq").agg(F.count(F.lit(1)).alias("own"))
    heads = turns.filter(F.col("d") <= most)
    size = heads.groupBy(F.col("seq").alias("head")).agg(F.count(F.lit(1)).alias("there"))
    h = F.crc32(F.col("seq").cast("string").cast("binary")) % (most + 1)
    taken = own.withColumns({"h": h, "head": F.col("seq") - F.col("seq") % every}).join(size, "head", "left")
    taken = stored(taken.withColumn("given", F.least("h", F.coalesce("there", F.lit(0)))).select("seq", "own", "h", "head", "given"), "heads")
    # a head serves fewer than every sequences, with most turns each
    front = taken.filter("given > 0").join(heads.withColumnRenamed("seq", "head"), "head").filter("d <= given").select("seq", "d", "key", "words")
    back = turns.join(taken.select("seq", "h", "given"), "seq").filter("d > h").select("seq", (F.col("given") + F.col("d") - F.col("h")).alias("d"), "key", "words")
    all_turns = stored(front.unionByName(back), "rebuilt")
    lengths = stored(taken.select("seq", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "lengths")
    drop_stored(taken)
    return all_turns, lengths


def _segments(turns: DataFrame, rounds: int) -> list[DataFrame]:
    """For each j < rounds the hash of each whole run of 2^j turns: seq, a (its number), h."""
    out = [turns.select("seq", (F.col("d") - 1).alias("a"), F.col("key").alias("h"))]
    for _ in range(1, rounds):
        half = out[-1].groupBy("seq", F.floor(F.col("a") / 2).alias("up")).agg(F.array_sort(F.collect_list(F.struct("a", "h"))).alias("two"))
        whole = half.filter(F.size("two") == 2).select("seq", F.col("up").alias("a"), _hash(F.col("two")[0]["h"], F.col("two")[1]["h"]).alias("h"))
        out.append(stored(whole, "segments"))
    return out


def prefix_names(turns: DataFrame, lengths: DataFrame, rounds: int) -> list[DataFrame]:
    """seq, d and name of each prefix of each sequence: the root's first, then those of the cuts of each round."""
    segments = _segments(turns, rounds)
    parts = [lengths.select("seq", F.lit(0).cast("long").alias("d"), F.lit(b"").alias("name"))]
    for j in reversed(range(rounds)):
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        below = segments[j].filter("a % 2 = 0").select("seq", (F.col("a") * 2**j).alias("d"), "h")
        cut = known.join(below, ["seq", "d"]).select("seq", (F.col("d") + 2**j).alias("d"), _hash(F.col("name"), F.col("h")).alias("name"))
        parts.append(stored(cut, "cuts"))
    if rounds > 1:
        drop_stored(*segments[1:])
    return parts


def _ends(last: DataFrame) -> DataFrame:
    """name and ends_sha256 of rows (name, seq): the ids of a name, ascending, joined by commas and hashed.

    Ids are sorted by range and joined CHUNK at a time, so what is hashed one after the
    other for a name that very many sequences share is a row for CHUNK of them; a task holds a batch of such rows.
    """
    rows = stored(last.orderBy("name", "seq").withColumn("m", F.monotonically_increasing_id()), "ends")
    inside = F.col("m").bitwiseAND((1 << _PLACE_BITS) - 1)
    chunk = F.struct(F.shiftright("m", _PLACE_BITS).alias("p"), F.floor(inside / CHUNK).alias("c"))
    joined = rows.groupBy("name", chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("seq")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            names, hashes = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == name:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    names.append(name)
                    hashes.append(state.hexdigest())
                name, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes, pa.string())], ["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["name", "ends_sha256"])

    found = stored(joined.repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids").mapInArrow(run, "name binary, ends_sha256 string"), "ends-hashed")
    drop_stored(rows)
    return found


def _added(to: DataFrame, what: DataFrame, by: DataFrame) -> DataFrame:
    """to (name, leaves, saved) plus what (name, leaves, saved) of the nodes that by (name, above) hangs below each."""
    more = by.join(what, "name").groupBy(F.col("above").alias("name")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    return to.join(more, "name", "left").select("name", "d", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))


def subtree_totals(values: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """name, leaves and saved summed over the subtree of each node.

    values: name, d, leaves, saved of each node. links: for each node and each j up to the
    zero bits at the end of its depth (rounds for the root) name, above (the node 2^j levels up), j and tail (is j the last of them).
    """
    # blocks of 2^j levels below each node whose depth is a multiple of 2^j: the forests of half that height are grafted on
    blocks = [values]
    for j in range(rounds):
        tops = blocks[-1].filter(F.col("d") % 2 ** (j + 1) == 0)
        low = blocks[-1].filter(F.col("d") % 2 ** (j + 1) != 0).select("name", "leaves", "saved")
        blocks.append(stored(_added(tops, low, links.filter((F.col("j") == j) & F.col("tail")).select("name", "above")), "blocks"))
    # whole subtrees: the root has its own; the others take what hangs below their block, from the largest blocks down
    whole = [blocks[-1]]
    for j in reversed(range(rounds)):
        done = whole[0]
        for w in whole[1:]:
            done = done.unionByName(w)
        tops = blocks[j].filter(F.col("d") % 2 ** (j + 1) != 0)
        whole.append(stored(_added(tops, done.select("name", "leaves", "saved"), links.filter((F.col("j") == j) & ~F.col("tail")).select("name", "above")), "subtrees"))
    out = whole[0]
    for w in whole[1:]:
        out = out.unionByName(w)
    drop_stored(*blocks[1:-1], keep=[out])
    return out.select("name", "leaves", "saved")


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (turns: seq, d, key, words; lengths: seq, n, of all sequences, turnless ones too).

    One row a node: name, parent (its name), conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    longest = lengths.agg(F.max("n")).first()[0] or 0
    rounds = int(longest).bit_length()  # 2^rounds > longest
    parts = prefix_names(turns, lengths, rounds)
    names = parts[0]
    for p in parts[1:]:
        names = names.unionByName(p)
    ends = _ends(names.join(lengths.withColumnRenamed("n", "d"), ["seq", "d"]).select("name", "seq"))
    nodes = stored(names.groupBy("name").agg(F.first("d").alias("d"), F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n")), "nodes")
    # ancestors 1, 2, 4 ... levels up, while that divides the depth; looked up in the node's smallest sequence
    d = F.col("d")
    zeros = F.lit(0)
    for j in range(1, rounds):
        zeros = F.when(d % 2**j == 0, j).otherwise(zeros)
    asked = nodes.filter("d > 0").select("name", "seq", "d", zeros.alias("zeros")).select("name", "seq", "zeros", F.explode(F.sequence(F.lit(0), F.col("zeros"))).alias("j"), "d")
    asked = asked.select("name", "seq", "j", (F.col("j") == F.col("zeros")).alias("tail"), (d - F.pow(F.lit(2), F.col("j")).cast("long")).alias("d"))
    links = stored(asked.join(names.withColumnRenamed("name", "above"), ["seq", "d"]).select("name", "above", "j", "tail"), "links")
    parent = links.filter("j = 0").select("name", F.col("above").alias("parent"))
    children = parent.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    last = turns.select("seq", "d", "words")
    values = nodes.join(children, "name", "left").join(last, ["seq", "d"], "left").join(parent, "name", "left")
    values = values.select("name", "parent", "d", "seq", "n", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("words", F.lit(0)).alias("words"))
    values = stored(values, "values")
    own = values.select("name", "d", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(own, links, rounds)
    above = nodes.select(F.col("name").alias("parent"), F.col("seq").alias("parent_conv_id"))
    out = values.join(totals, "name").join(ends, "name", "left").join(above, "parent", "left")
    return out.select(
        "name", "parent", F.col("seq").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
