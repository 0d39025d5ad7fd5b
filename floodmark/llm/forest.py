"""Near duplicates of embeddings by a forest of random projection trees.

Each tree splits the vectors at the median of a random projection, again and
again; vectors near a split go to both sides. Where a sample of a node holds a
group of near vectors, the split is chosen to keep linked pairs together, and a
node that no such split divides stays whole. Vectors that share a leaf of any
tree are compared exactly. The tops of the trees are fitted on a bounded sample,
which bounds what is broadcast, and every vector is put into them; leaves that
hold more than ``max_leaf`` vectors are split further, all at once and each by a
bounded sample of its own within a task, until none is left that can be split.
These further splits stay in tables and meet the vectors of their leaf in a
shuffle. Nothing is capped: a leaf that stays large is dealt in pairs of blocks
over many tasks.

Equal vectors form one class that goes through the trees once. A pair is counted
in the first leaf that both share, so no pair is sent anywhere: a leaf gives one
row for each vector with links.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components has no links and is a component of its own. Shorter vectors count as
filled with zeros. A row without an id has no component and is kept. Extra
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components

TREES, LEAF, SPILL = 8, 400, 0.06
#: Vectors that the tops of the trees are fitted on, those that a large leaf is split by, and the least of them that a split needs.
FIT_ROWS, LEAF_ROWS, FIT_LEAST = 20_000, 8_000, 40
#: Vectors of a large leaf that one task puts into its further splits.
DEALT_ROWS = 50_000
#: Node numbers double with each level and are kept with the tree in a long.
LAST_NODE = 1 << 56
MAX_LEAF = 4000
BLOCK = 1024
#: Vectors of a node that are compared to see whether it holds a group, and the linked pairs that make one.
SEEN, GROUP_PAIRS = 400, 80
#: Part of the linked pairs that a split may part, and the directions and places that are tried.
PARTED, TRIES, PLACES = 0.01, 12, (0.5, 0.4, 0.6, 0.3, 0.7)
#: Pairs up to which each is looked at by itself.
FEW_PAIRS = 20_000
#: The side of a vector whose own block is compared.
OWN = 2


def _direction(tree: int, node: int, dim: int, nth: int = 0) -> np.ndarray:
    return np.random.default_rng((17, tree, node, nth) if nth else (17, tree, node)).standard_normal(dim)


class Forest:
    """For each tree and node the bounds of its split and the number of its direction; directions follow from their numbers."""

    def __init__(self, trees: int, dim: int, cosine: float = 0.9):
        self.trees, self.dim, self.cosine = trees, dim, cosine
        self.splits: dict[tuple[int, int], tuple[float, float, int]] = {}

    def grow(self, tree: int, node: int, x: np.ndarray, least: int, spill: float) -> None:
        if len(x) < max(2 * least, 2) or node >= LAST_NODE:
            return
        split = self._split(tree, node, x, spill)
        if split is None:
            return
        low, high, nth = self.splits[tree, node] = split
        p = x @ _direction(tree, node, self.dim, nth)
        self.grow(tree, 2 * node, x[p <= high], least, spill)
        self.grow(tree, 2 * node + 1, x[p >= low], least, spill)

    def _split(self, tree: int, node: int, x: np.ndarray, spill: float) -> tuple[float, float, int] | None:
        """The median of the first direction; where the node holds a group, the place that parts the fewest linked pairs, or none."""
        seen = x[:: -(-len(x) // SEEN)]
        u, v = np.nonzero(np.triu(seen @ seen.T >= self.cosine, 1))
        group = len(u) >= GROUP_PAIRS
        best, parted = None, np.inf
        for nth in range(TRIES if group else 1):
            p = x @ _direction(tree, node, self.dim, nth)
            if group:
                q = p[:: -(-len(x) // SEEN)]
                near, far = np.minimum(q[u], q[v]), np.maximum(q[u], q[v])
            for place in PLACES if group else (0.5,):
                low, high = np.quantile(p, [max(place - spill, 0), min(place + spill, 1)])
                if not p.min() < low <= high < p.max():
                    continue
                lost = np.count_nonzero((near < low) & (far > high)) if group else 0
                if lost < parted and lost <= PARTED * len(u):
                    best, parted = (float(low), float(high), nth), lost
            if parted == 0:
                break
        return best

    def descend(self, tree: int, node: int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves below a node, with the rows of x that reach each."""
        todo = [(node, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            split = self.splits.get((tree, node))
            if split is None or not len(rows):
                yield node, rows
                continue
            p = x[rows] @ _direction(tree, node, self.dim, split[2])
            todo += [(2 * node, rows[p <= split[1]]), (2 * node + 1, rows[p >= split[0]])]

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """Leaves of each vector, as numbers that hold the tree: node * trees + tree."""
        out: list[list[int]] = [[] for _ in x]
        for tree in range(self.trees):
            for node, rows in self.descend(tree, 1, x):
                for r in rows.tolist():
                    out[r].append(node * self.trees + tree)
        return [sorted(v) for v in out]


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.zeros((len(raw), dim))
    for i, b in enumerate(raw):
        v = np.frombuffer(b, "<f8")
        x[i, : len(v)] = v
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, fp (names the vector; null if it links with nothing), v (its components as doubles) and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, vec, size = [], [], []
            for x in batch.column(1).to_pylist():
                v = np.zeros(0) if x is None or None in x else np.array(x, np.float64)
                if len(v) and np.isfinite(v).all() and v.any():
                    v = np.trim_zeros(v + 0.0, "b")
                    vec.append(v.astype("<f8").tobytes())
                    fp.append(hashlib.blake2b(vec[-1], digest_size=16).digest())
                    size.append(len(v))
                else:
                    fp.append(None)
                    vec.append(None)
                    size.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary()), pa.array(vec, pa.binary()), pa.array(size, pa.int32())], names=["id", "fp", "v", "size"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), vec_col).mapInArrow(run, f"id {kind}, fp binary, v binary, size int")


def _placed(classes: DataFrame, forest: Forest) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                own = shared.value.leaves(_unit(part.column(part.schema.get_field_index("v")).to_pylist(), shared.value.dim))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.list_(pa.int64()))], names=[*part.schema.names, "leaves"])

    kind = classes.schema["node"].dataType.simpleString()
    return classes.mapInArrow(run, f"fp binary, node {kind}, k long, v binary, leaves array<bigint>")


def _sampled(df: DataFrame, rows: int, n: Column) -> DataFrame:
    """About so many of n rows, by the hash of their vectors; all where there are no more."""
    return df.filter((n <= rows) | (F.pmod(F.xxhash64("fp"), F.lit(1_000_003)) < F.lit(1_000_003.0 * rows) / F.greatest(n, F.lit(1))))


def _grown(placed: DataFrame, large: DataFrame, forest: Forest, leaf_vectors: int, spill: float, leaf_rows: int) -> DataFrame:
    """For each large leaf the splits below it: leaf, and arrays of nodes, low, high, nth (empty where nothing splits it)."""
    trees, dim, cosine = forest.trees, forest.dim, forest.cosine

    def grow(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        leaf, size = key[0].as_py(), rows["n"][0].as_py()
        x = _unit(rows["v"].to_pylist(), dim)
        own = Forest(trees, dim, cosine)
        own.grow(leaf % trees, leaf // trees, x, max(FIT_LEAST, int(leaf_vectors * len(x) / size)), spill)
        low, high, nth = ([v[i] for v in own.splits.values()] for i in range(3))
        lists = [pa.array([v], pa.list_(t)) for v, t in (([node for _, node in own.splits], pa.int64()), (low, pa.float64()), (high, pa.float64()), (nth, pa.int32()))]
        return pa.Table.from_arrays([pa.array([leaf], pa.int64()), *lists], names=["leaf", "nodes", "low", "high", "nth"])

    rows = placed.select(F.explode("leaves").alias("leaf"), "fp", "v").join(large, "leaf")
    schema = "leaf long, nodes array<long>, low array<double>, high array<double>, nth array<int>"
    return _sampled(rows, leaf_rows, F.col("n")).select("leaf", "n", "v").groupBy("leaf").applyInArrow(grow, schema)


def _moved(placed: DataFrame, large: DataFrame, splits: DataFrame, forest: Forest) -> DataFrame:
    """For each vector of a leaf with further splits: fp, leaf, and the leaves below it that the vector reaches.

    A large leaf is dealt over several tasks; its splits go to each of them and
    come before the vectors.
    """
    trees, dim, cosine = forest.trees, forest.dim, forest.cosine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, own = None, Forest(trees, dim, cosine)
        for batch in batches:
            leaves, vector = batch.column(0).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], (leaves[1:] != leaves[:-1]) | (vector[1:] != vector[:-1])])) if len(leaves) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(leaves)).tolist(), strict=True):
                part = batch.slice(a, b - a)
                if not vector[a]:
                    leaf, own = int(leaves[a]), Forest(trees, dim, cosine)
                    nodes, low, high, nth = (part.column(i)[0].as_py() for i in range(3, 7))
                    own.splits = {(leaf % trees, node): s for node, *s in zip(nodes, low, high, nth, strict=True)}
                    continue
                x = _unit(part.column(2).to_pylist(), dim)
                out: list[list[int]] = [[] for _ in x]
                for node, rows in own.descend(leaf % trees, leaf // trees, x):
                    for r in rows.tolist():
                        out[r].append(node * trees + leaf % trees)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), pa.array(out, pa.list_(pa.int64()))], names=["fp", "leaf", "below"])

    counted = splits.join(large, "leaf").withColumn("tasks", F.ceil(F.col("n") / DEALT_ROWS))
    own = counted.select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "nodes", "low", "high", "nth")
    rows = placed.select(F.explode("leaves").alias("leaf"), "fp", "v").join(counted.select("leaf", "tasks"), "leaf").select("leaf", F.pmod(F.xxhash64("fp"), "tasks").alias("task"), "fp", "v")
    both = own.unionByName(rows, allowMissingColumns=True).repartition("leaf", "task").sortWithinPartitions("leaf", "task", F.asc_nulls_first("fp"))
    return both.select("leaf", "fp", "v", "nodes", "low", "high", "nth").mapInArrow(run, "fp binary, leaf long, below array<long>")


def fit_forest(classes: DataFrame, dim: int, *, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS, max_leaf: int = MAX_LEAF, cosine: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """Classes with their leaves, and leaf and n of the leaves that stay large. classes: fp, node, k, v.

    The driver sees fit_rows vectors and whether large leaves are left, nothing else.
    """
    forest = Forest(trees, dim, cosine)
    n = classes.count()
    x = _unit([r["v"] for r in _sampled(classes, fit_rows, F.lit(n)).select("v").collect()], dim)  # about fit_rows vectors
    least = max(FIT_LEAST, int(leaf * min(1.0, fit_rows / max(n, 1))))
    for t in range(trees):
        forest.grow(t, 1, x, least, spill)
    placed = stored(_placed(classes, forest), "leaves", "none")
    whole = None  # large leaves that nothing splits
    while True:
        sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > max_leaf)
        large = stored(sizes if whole is None else sizes.join(whole, "leaf", "left_anti"), "large-leaves")
        if large.isEmpty():
            return placed, large if whole is None else whole
        grown = stored(_grown(placed, large, forest, leaf, spill, leaf_rows), "splits")
        still = large.join(grown.filter(F.size("nodes") > 0), "leaf", "left_anti")
        whole = stored(still if whole is None else whole.unionByName(still), "whole-leaves")
        moved = _moved(placed, large, grown.filter(F.size("nodes") > 0), forest).groupBy("fp").agg(F.collect_list("leaf").alias("gone"), F.flatten(F.collect_list("below")).alias("below"))  # at most the leaves of a vector
        none = F.array().cast("array<long>")
        leaves = F.array_sort(F.concat(F.array_except("leaves", F.coalesce("gone", none)), F.coalesce("below", none)))
        placed = stored(placed.join(moved, "fp", "left").select("fp", "node", "k", "v", leaves.alias("leaves")), "leaves", "none")


def _dealt(placed: DataFrame, whole: DataFrame, max_leaf: int) -> DataFrame:
    """Rows of each leaf as part 0; those of a leaf that stays large as one part for each pair of its blocks."""
    rows = placed.select(F.explode("leaves").alias("leaf"), "fp", "node", "k", "v", "leaves")
    zero = F.lit(0).cast("long")
    rows = rows.join(whole.select("leaf", F.ceil(F.col("n") / max_leaf).alias("blocks")), "leaf", "left").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("blocks") - 1))))
    part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    side = F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(OWN)
    return rows.withColumns({"part": F.when(F.col("blocks").isNull(), zero).otherwise(part), "side": side}).select("leaf", "part", "side", "node", "k", "v", "leaves")


def _linked(placed: DataFrame, whole: DataFrame, dim: int, least: float, max_leaf: int) -> DataFrame:
    """For each leaf and each of its vectors with links: node, near (a smaller or equal node joined to it), links (vectors of the pairs that this leaf counts)."""
    kind = placed.schema["node"].dataType.simpleString()

    def leaf_rows(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        leaves, parts, sides = (rows[c].to_numpy() for c in ("leaf", "part", "side"))
        cut = np.flatnonzero(np.append(True, (leaves[1:] != leaves[:-1]) | (parts[1:] != parts[:-1])))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(leaves)).tolist(), strict=True):
            if b - a < 2:
                continue
            part, leaf, side = rows.slice(a, b - a), leaves[a], sides[a:b]
            node, k = part["node"].to_numpy(), part["k"].to_numpy()
            x = _unit(part["v"].to_pylist(), dim)
            own = part["leaves"].to_pylist()
            width = max(map(len, own))
            codes = np.array([v + [-1 - i] * (width - len(v)) for i, v in enumerate(own)])
            links, root = np.zeros(b - a, np.int64), np.arange(b - a)
            within = side[0] == OWN
            left, right = (np.arange(b - a),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            earlier = None
            for i in range(0, len(left), BLOCK):
                for j in range(i if within else 0, len(right), BLOCK):
                    at, to = left[i : i + BLOCK], right[j : j + BLOCK]
                    near = x[at] @ x[to].T >= least
                    if within and i == j:
                        near = np.triu(near, 1)
                    if np.count_nonzero(near) <= FEW_PAIRS:
                        p, q = np.nonzero(near)
                        u, v = at[p], to[q]
                        root = _union(root, u, v)
                        same = (codes[u][:, :, None] == codes[v][:, None, :]).any(axis=2)
                        mine = codes[u][np.arange(len(u)), same.argmax(axis=1)] == leaf  # leaves are sorted
                        links += np.bincount(u[mine], k[v[mine]], minlength=b - a).astype(np.int64) + np.bincount(v[mine], k[u[mine]], minlength=b - a).astype(np.int64)
                        continue
                    while True:  # most pairs are joined by the first of them
                        p, q = np.nonzero(near & (root[at][:, None] != root[to][None, :]))
                        if not len(p):
                            break
                        root = _union(root, at[p[:FEW_PAIRS]], to[q[:FEW_PAIRS]])
                    if earlier is None:
                        earlier = _members(codes, leaf)
                    if earlier.shape[1]:
                        near &= earlier[at] @ earlier[to].T < 0.5
                    links[at] += np.where(near, k[to][None, :], 0).sum(axis=1)
                    links[to] += np.where(near, k[at][:, None], 0).sum(axis=0)
            shown = (links > 0) | (root != np.arange(b - a))
            yield node[shown], node[root[shown]], links[shown]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = np.flatnonzero((leaf != leaf[-1]) | (part != part[-1]))
            over = int(last[-1]) + 1 if len(last) else 0
            if held and not over and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) == (leaf[0], part[0]):
                held.append(batch)
                continue
            done = [*held, batch.slice(0, over)]
            held = [batch.slice(over)]
            if not over:  # what was held is over, the new leaf is not
                done = done[:-1]
            if done:
                yield from (pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["node", "near", "links"]) for a, b, c in leaf_rows(pa.Table.from_batches(done)))
        if held:
            yield from (pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["node", "near", "links"]) for a, b, c in leaf_rows(pa.Table.from_batches(held)))

    dealt = _dealt(placed, whole, max_leaf).repartition("leaf", "part").sortWithinPartitions("leaf", "part", "node")
    return dealt.mapInArrow(run, f"node {kind}, near {kind}, links long")


def _members(codes: np.ndarray, leaf: int) -> np.ndarray:
    """Ones where a vector (row) is in a leaf before this one (column) that others of the rows are in too."""
    row, col = np.nonzero((codes >= 0) & (codes < leaf))
    _, nth, n = np.unique(codes[row, col], return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    out = np.zeros((len(codes), int((n > 1).sum())), np.float32)
    shared = n[nth] > 1
    out[row[shared], column[nth[shared]]] = 1
    return out


def _union(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest members of the components after joining u and v."""
    while True:
        a, b = root[u], root[v]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            further = new[new]
            if (further == new).all():
                break
            new = further
        if (new == root).all():
            return root
        root = new


def near_duplicate_vectors(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, **options) -> DataFrame:
    """id_col, n_links, component_id and kept of each row: pairs found whose cosine is at least least."""
    rows = stored(_vectors(df, id_col, vec_col), "vectors", "none")
    dim = rows.agg(F.max("size")).first()[0] or 1
    classes = stored(rows.filter("fp is not null and id is not null").groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("k"), F.first("v").alias("v")), "classes", "none")
    placed, whole = fit_forest(classes, dim, cosine=least, **options)
    found = stored(_linked(placed, whole, dim, least, options.get("max_leaf", MAX_LEAF)), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("near").alias("b")))
    state = classes.select("fp", "node", "k").join(links, "node", "left").join(comp, "node", "left")
    state = state.select("fp", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n_links"), F.coalesce("label", "node").alias("component"))
    out = rows.select("id", "fp").join(state, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    n_links = F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.select(F.col("id").alias(id_col), n_links.alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
