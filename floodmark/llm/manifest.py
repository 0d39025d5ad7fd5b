"""A Merkle manifest of a dataset: a tree for each group (source) of rows, a tree over their roots, proofs.

Every level is a self-join. A node has its tree, its number there, and the count of
nodes of its level. Nodes of slot zero compute the numbers of their siblings (number
XOR 1 in a binary tree, number + 1, + 2 ... otherwise), equijoin the nodes of those
numbers, and emit the parent with the hashes of its children in order; a node finds
its siblings for a proof with its slot-zero node, whose number is computed too. Trees
of all groups grow side by side; keys are (tree, number), so a hot group is spread.
Paths are handed down from the roots, one equijoin a level.

Defined results: a null group is one of its own and comes first; null fields are told
from empty ones; null ids come first in their group; rows with equal ids are ordered by
their leaves, and equal rows are leaves of their own. A tree of one leaf has that leaf as
its root. An empty table has no root and gives no rows. Texts of any length are
hashed where they are read. Other columns of the table are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .order import kept_numbered

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """The hash of all nodes: lowercase hex of SHA-256."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf: '-' for null, else its UTF-8 bytes, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def tree_of(group: Column) -> Column:
    """A name for the tree of a group that sorts like the group, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def grow(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level of all trees that have more than one node: tree, number, n, hash and the hashes of the children.

    nodes: tree, number, n (nodes of that tree at this level), hash.
    """
    number = F.col("number")
    near = F.array(number.bitwiseXOR(F.lit(1).cast("long"))) if fanout == 2 else F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)), lambda k: number + k)
    zero = nodes.filter((F.col("n") > 1) & (number % fanout == 0)).withColumn("near", F.filter(near, lambda k: k < F.col("n")))
    asked = zero.select("tree", "n", F.floor(number / fanout).alias("up"), F.col("hash").alias("own"), F.explode_outer("near").alias("number"))
    met = asked.join(nodes.select("tree", "number", "hash"), ["tree", "number"], "left")
    sibling = F.when(F.col("hash").isNotNull(), F.struct("number", "hash"))
    runs = met.groupBy("tree", "up").agg(F.first("own").alias("own"), F.first("n").alias("n"), F.array_sort(F.collect_list(sibling)).alias("near"))
    runs = runs.withColumn("children", F.concat(F.array("own"), F.transform("near", lambda s: s["hash"])))
    return runs.select("tree", F.col("up").alias("number"), F.ceil(F.col("n") / fanout).alias("n"), digest(F.array_join("children", "")).alias("hash"), "children")


def levels_of(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels of the trees over leaves (tree, number, n, hash, ...), leaves first. The driver learns one number, the most leaves of a tree."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    out = [leaves]
    while most > 1:
        out.append(stored(grow(out[-1], fanout), "merkle-level"))
        most = -(-most // fanout)
    return out


def _entry(number: Column, children: Column, fanout: int) -> Column:
    """The siblings of a node, those on its left and those on its right, each joined."""
    slot = (number % fanout).cast("int")
    return F.struct(F.array_join(F.slice(children, F.lit(1), slot), "").alias("before"), F.array_join(F.slice(children, slot + 2, F.lit(fanout)), "").alias("after"))


def paths(levels: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves with top (a struct of what belongs to their tree) and path: the siblings of each level from the leaf to its root, and then those of tops.

    tops: tree, top, path (what follows above the root of that tree).
    """
    above: DataFrame | None = None
    for level in reversed(range(len(levels))):
        nodes = levels[level].drop("children")
        end = nodes.filter("n = 1").join(tops, "tree")
        if above is not None:
            up = above.withColumnsRenamed({"number": "up", "path": "rest"})
            found = nodes.filter("n > 1").withColumn("up", F.floor(F.col("number") / fanout)).join(up, ["tree", "up"])
            path = F.concat(F.array(_entry(F.col("number"), F.col("children"), fanout)), "rest")
            end = end.unionByName(found.select(*nodes.columns, "top", path.alias("path")))
        if level:
            kept = stored(end.select("tree", "number", "top", "path").join(levels[level].select("tree", "number", "children"), ["tree", "number"]), "merkle-paths")
            if above is not None:
                drop_stored(above)
            above = kept
    return end


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf has with the siblings of a path."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def proof_text(path: Column) -> Column:
    """The siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


@dataclass
class Manifest:
    """root: of all groups, null without rows. leaves: the given columns with tree, number, n, hash, top (struct<subroot>) and path."""

    root: str | None
    leaves: DataFrame
    groups: DataFrame


def build(leaves: DataFrame, order: Sequence[str], *, fanout: int = FANOUT) -> Manifest:
    """Trees over leaves (tree, hash and columns of their own), ordered within a tree by order and hash."""
    placed = kept_numbered(leaves, ["tree"], [*order, "hash"], "number", "n")
    levels = levels_of(placed, fanout)
    roots = None
    for nodes in levels:
        one = nodes.filter("n = 1").select("tree", F.col("hash").alias("subroot"))
        roots = one if roots is None else roots.unionByName(one)
    # the tree over the groups: one tree, its leaves ordered by the names of the trees
    groups = kept_numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("subroot").alias("hash")), ["tree"], ["group"], "number", "n")
    upper = levels_of(groups, fanout)
    top = upper[-1].filter("n = 1").select("hash").first()
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    bare = groups.limit(1).select("tree", F.lit(None).cast("string").alias("top"), nothing.alias("path"))
    tops = stored(paths(upper, bare, fanout).select(F.col("group").alias("tree"), F.struct(F.col("hash").alias("subroot")).alias("top"), "path"), "merkle-tops")
    drop_stored(*upper[1:])
    return Manifest(top[0] if top else None, paths(levels, tops, fanout), groups.select("group", "number", "hash"))


def manifest(docs: DataFrame, *, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", seen: Column | None = None, fanout: int = FANOUT) -> tuple[str | None, DataFrame]:
    """The root of docs, and for each row: order, group, leaf, subroot, path, and folded: the root from the leaf now seen.

    seen: the text (the last of fields) as it is now; the leaf of the manifest is of the
    given one. A row is as it was if folded equals the root.
    """
    given = [F.col(f) for f in fields]
    now = leaf_of(*given[:-1], seen) if seen is not None else leaf_of(*given)
    leaves = stored(docs.select(F.col(order).alias("id"), F.col(group).alias("group"), tree_of(F.col(group)).alias("tree"), leaf_of(*given).alias("hash"), now.alias("now")), "leaves")
    built = build(leaves, ["id"], fanout=fanout)
    drop_stored(leaves)
    rows = built.leaves.select(F.col("id").alias(order), F.col("group").alias(group), F.col("hash").alias("leaf"), F.col("top.subroot").alias("subroot"), "path", fold(F.col("now"), F.col("path")).alias("folded"))
    return built.root, rows
