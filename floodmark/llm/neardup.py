"""Near duplicates of texts by SetSketch registers, bands, joint likelihood and exact sets.

A text becomes its set of word shingles. Documents with equal sets form a class,
of which one member goes on. Each register of a class's sketch is a truncated
logarithm (base ``BASE``) of a minimum of exponential variables over the set;
registers of a union are the larger ones. Bands of equal registers propose pairs;
the likelihood of both sketches, with the known set sizes, rejects pairs that are
far below the threshold; the rest are settled on the full sets.

No bucket's pairs are listed. Buckets are dealt in blocks. First each member is
compared with the first of its block and the one before it; what passes makes first
components. Then members of different components meet within blocks: by their
sketches, and where those do not rule a pair out, by their sets, which go to a block
once for each member that needs it. A block gives links only, and none inside a
component, which would change nothing: the components are those of all pairs.

Defined results: a text without words (or null) has an empty set, links with
nothing and is a component of its own; a text of fewer words than a shingle is
one shingle. A row without an id is not linked, has no component and is kept.
Rows of one id and text are one class. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, stored
from .graph import components

#: Registers in a band and bands: at a similarity of 0.8 a pair shares none in 5e-5 of cases, at 0.85 in 2e-6.
ROWS, BANDS = 6, 28
#: Base and rate of the registers.
BASE, RATE = 1.1, 20.0
#: Difference of log-likelihood that rules a pair out (five standard deviations).
MARGIN = 12.5
#: Members of a bucket in a block, and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
CHUNK_CHARS = 1_000_000
_M = ROWS * BANDS
_SEED = np.random.default_rng(5)
_MIX = _SEED.integers(1, 2**63, 256, dtype=np.uint64)
_A = _SEED.integers(1, 2**63, _M, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _SEED.integers(1, 2**63, _M, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its shingles."""
    for a, b in slices(texts, CHUNK_CHARS):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        if not _powers or len(_powers[0]) < len(data):
            n = max(len(data), 1 << 20)
            _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, p, np.uint64)))) for p in (_P, pow(_P, -1, 2**64))]
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~_BLANK[data]
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        ws, we = edge[0::2], edge[1::2]
        total = np.concatenate(([np.uint64(0)], np.cumsum(_MIX[_LOWER[data]] * _powers[0][: len(data)])))
        words = _mixed((total[we] - total[ws]) * _powers[1][ws] if len(ws) else np.zeros(0, np.uint64))
        words = _mixed(words + (we - ws).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        begins = np.cumsum([0] + [len(x) + 1 for x in raw])
        at = np.searchsorted(ws, begins)
        n = max(0, len(words) - k + 1)
        joined = np.zeros(n, np.uint64)
        for i in range(k):
            joined = _mixed(joined * np.uint64(0x9FB21C651E98DF25) + words[i : i + n])
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if y - x >= k:
                yield np.unique(joined[x : y - k + 1])
            elif y > x:
                h = np.array([y - x], np.uint64)
                for i in range(x, y):
                    h = _mixed(h * np.uint64(0x9FB21C651E98DF25) + words[i])
                yield h
            else:
                yield np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set. Those of a union are np.maximum of its parts'."""
    least = np.full(_M, np.uint64(2**64 - 1))
    for i in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[i : i + 1024, None] ^ _B) * _A).min(axis=0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def unlikely(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the joint likelihood of two sketches rules out a similarity of threshold or more.

    Compares the likelihood at threshold with its largest value below it, on a grid.
    """
    more, less = (ka > kb).sum(axis=1), (ka < kb).sum(axis=1)
    same = ka.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def log_l(j):
        p, q = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    at = log_l(threshold)
    best = at.copy()
    top = np.minimum(u / v, v / u)
    for j in np.arange(0.02, threshold, 0.04):
        np.maximum(best, np.where(j <= top, log_l(np.minimum(j, top)), -np.inf), out=best)
    above = log_l(np.minimum(top, (1 + threshold) / 2))
    return (best - np.maximum(at, above) > MARGIN) | (top < threshold - 1e-9)


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n (shingles), fp (128 bits that name the set) and sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            n, fp, sig = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), k):
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(sketch(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "fp", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {kind}, n long, fp binary, sig binary")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """node and its set (sorted hashes). Of repeated ids the row with the node's own set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), k)]
            own = [hashlib.blake2b(s, digest_size=16).digest() == fp for s, fp in zip(sets, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "s"]).filter(pa.array(own))

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("t")).join(nodes.select("node", "fp"), "node").select("node", "t", "fp")
    return found.mapInArrow(run, f"node {kind}, s binary")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs a, b whose sets have den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    y = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if batch.num_rows:
                n = [np.array(batch.column(i).to_pylist(), np.float64) for i in (2, 3)]
                k = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, _M) for i in (4, 5)]
                ok = ~unlikely(k[0], k[1], n[0], n[1], threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    x = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ka"))
    y = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("kb"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, f"a {kind}, b {kind}")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """The block (key and number) of each stretch of rows, whether they are probes, and the rows. In a block the rows at home come first."""
    for batch in small_batches(batches):
        if batch.num_rows:
            marks = np.array([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "block", "probe")])
            cut = np.flatnonzero(np.append(True, (marks[:, 1:] != marks[:, :-1]).any(axis=0)))
            for i, j in zip(cut.tolist(), np.append(cut[1:], batch.num_rows).tolist(), strict=True):
                yield (int(marks[0, i]), int(marks[1, i])), bool(marks[2, i]), batch.slice(i, j - i)


def _column(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    return rows[name].to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows[name].to_numpy()


def _flagged(members: DataFrame, threshold: float) -> DataFrame:
    """The members of blocks that have a likely partner in another component there.

    members: key, block, probe, band, node, comp, minor, n, sig. Probes are compared
    with the members at home as they come, so a task holds one block and a batch. A
    pair counts only in the first band that both share.
    """
    kind = members.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(rows):
            sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(-1, _M)
            return _column(rows, "node"), _column(rows, "comp"), _column(rows, "minor"), _column(rows, "n").astype(np.float64), sig, _column(rows, "band")

        def chosen(rows, flags: np.ndarray) -> pa.RecordBatch:
            rows = rows.select(["key", "block", "probe", "node", "comp", "minor"]).filter(pa.array(flags))
            return rows.combine_chunks().to_batches()[0] if isinstance(rows, pa.Table) and rows.num_rows else rows

        at, held, home, flags = None, [], None, np.zeros(0, bool)
        for here, probe, rows in _stretches(batches):
            if here != at:
                if flags.any():
                    yield chosen(table, flags)
                at, held, home, flags = here, [], None, np.zeros(0, bool)
            if not probe:
                held.append(rows)
                continue
            if not held:
                continue
            if home is None:
                table = pa.Table.from_batches(held)
                home, flags = read(table), np.zeros(table.num_rows, bool)
            node, comp, minor, n, sig, band = home
            own = read(rows)
            likely = np.zeros(rows.num_rows, bool)
            step = max(1, 300_000 // len(node))
            for p in range(0, rows.num_rows, step):
                q = min(p + step, rows.num_rows)
                ok = (own[1][p:q, None] != comp[None, :]) & ~(minor[None, :] & (node[None, :] > own[0][p:q, None]))
                ok &= np.minimum(own[3][p:q, None], n[None, :]) >= (threshold - 1e-9) * np.maximum(own[3][p:q, None], n[None, :])
                x, y = np.nonzero(ok)
                x += p
                shared = (own[4][x] == sig[y]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band[0]
                x, y = x[shared], y[shared]
                if len(x):
                    ok = ~unlikely(own[4][x], sig[y], own[3][x], n[y], threshold)
                    likely[x[ok]] = flags[y[ok]] = True
            if likely.any():
                yield chosen(rows, likely)
        if flags.any():
            yield chosen(table, flags)

    comp_kind = members.schema["comp"].dataType.simpleString()
    return members.mapInArrow(run, f"key long, block int, probe int, node {kind}, comp {comp_kind}, minor boolean")


def _settled(flagged: DataFrame, num: int, den: int) -> DataFrame:
    """Links a, b between components: exact comparisons of sets within blocks.

    flagged: key, block, probe, node, comp, minor, s. Components that a link has
    joined are not compared again, so a block gives fewer links than it has members.
    """
    kind = flagged.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, home = None, [], None
        for here, probe, rows in _stretches(batches):
            if here != at:
                at, held, home = here, [], None
            if not probe:
                held.append(rows)
            elif held:
                home = home or _Block(pa.Table.from_batches(held), num, den)
                found = home.links(rows)
                if found:
                    a, b = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return flagged.mapInArrow(run, f"a {kind}, b {kind}")


class _Block:
    """The sets of the members at home in a block, by the places of their elements among all elements of the block."""

    def __init__(self, rows: pa.Table, num: int, den: int):
        self.num, self.den = num, den
        self.node, self.minor = _column(rows, "node"), _column(rows, "minor")
        sets = [np.frombuffer(x, np.uint64) for x in rows["s"].to_pylist()]
        self.size = np.array([len(x) for x in sets])
        self.start = np.cumsum(self.size) - self.size
        self.all, self.places = np.unique(np.concatenate(sets), return_inverse=True)
        self.code: dict = {}
        self.parent: list[int] = []
        self.root = np.array([self._root(c) for c in _column(rows, "comp").tolist()])

    def _root(self, comp) -> int:
        k = self.code.setdefault(comp, len(self.parent))
        if k == len(self.parent):
            self.parent.append(k)
        while self.parent[k] != k:
            k = self.parent[k]
        return k

    def links(self, rows: pa.RecordBatch) -> list[tuple]:
        out = []
        for node, comp, s in zip(*(rows[c].to_pylist() for c in ("node", "comp", "s")), strict=True):
            s, root = np.frombuffer(s, np.uint64), self._root(comp)
            fits = self.den * np.minimum(self.size, len(s)) >= self.num * np.maximum(self.size, len(s))
            asked = np.flatnonzero((self.root != root) & fits & ~(self.minor & (self.node > node)))
            if not len(asked):
                continue
            place = np.minimum(np.searchsorted(self.all, s), len(self.all) - 1)
            own = np.zeros(len(self.all), bool)
            own[place[self.all[place] == s]] = True
            size = self.size[asked]
            begin = np.cumsum(size) - size
            both = np.add.reduceat(own[self.places[np.repeat(self.start[asked] - begin, size) + np.arange(int(size.sum()))]], begin, dtype=np.int64)
            for y in asked[self.den * both >= self.num * (size + len(s) - both)].tolist():
                other = int(self.root[y])
                if other != root:
                    out.append((node, int(self.node[y]) if isinstance(node, int) else self.node[y]))
                    self.parent[other] = root
                    self.root[self.root == other] = root
        return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id_col, n_shingles, component_id (the smallest id reachable) and kept, one row per row of docs.

    Links documents whose sets have den * intersection >= num * union.
    """
    threshold = num / den
    docs = docs.select(id_col, text_col)
    rows = stored(sketches(docs, id_col, text_col, shingle), "sketches")
    solid = rows.filter("n > 0 and id is not null")
    classes = stored(solid.groupBy("fp").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    # one id may have rows of several sets: those are different nodes with one name, linked by it
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * ROWS + 1, F.lit(ROWS))))
    buckets = classes.select("node", "n", F.posexplode(bands).alias("band", "key"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size"), blocks.alias("blocks"), F.min("node").alias("least")).filter("size > 1").drop("size")
    buckets = buckets.drop("n").join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    w = Window.partitionBy("key", "block").orderBy("node")
    buckets = stored(buckets.withColumns({"lead": F.first("node").over(w), "prev": F.lag("node").over(w)}), "buckets")
    # each member beside the first of its block and the one before it, the firsts beside the first of all
    a = F.explode(F.when(F.col("prev").isNull(), F.array("least")).otherwise(F.array("lead", "prev")))
    near = buckets.select(a.alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()
    first = stored(_likely(near, classes, threshold), "pairs")
    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    sets = stored(_sets(docs, classes.join(nodes, "node"), id_col, text_col, shingle), "sets", "none")
    linked = stored(_verified(first, sets, num, den), "links")
    comp = components(linked).withColumnRenamed("label", "comp")
    # buckets in which several components meet
    named = buckets.join(comp, "node", "left").select("key", "band", "block", "blocks", "node", F.coalesce("comp", "node").alias("comp"))
    meet = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("key")
    common = named.groupBy("key", "comp").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "comp"))["comp"].alias("largest"))
    asked = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array().cast("array<int>"))
    dealt = F.concat(F.array(F.struct("block", F.lit(0).alias("probe"))), F.transform(asked, lambda i: F.struct(i.alias("block"), F.lit(1).alias("probe"))))
    members = named.join(meet, "key").join(common, "key").withColumn("minor", F.col("comp") != F.col("largest")).join(classes.select("node", "n", "sig"), "node")
    members = members.select("key", "band", F.explode(dealt).alias("x"), "node", "comp", "minor", "n", "sig").select("key", "x.block", "x.probe", "band", "node", "comp", "minor", "n", "sig")
    together = lambda df: df.repartition("key", "block").sortWithinPartitions("key", "block", "probe", "node")
    flagged = stored(_flagged(together(members), threshold), "flagged")
    missing = flagged.select("node").distinct().join(sets.select("node"), "node", "left_anti")
    rest = stored(_sets(docs, classes.join(missing, "node"), id_col, text_col, shingle), "sets", "none")
    more = _settled(together(flagged.join(sets.union(rest), "node").select(*flagged.columns, "s")), num, den)
    final = components(linked.union(more)).withColumnRenamed("label", "component")
    reach = classes.select("fp", "node").join(final, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = rows.select("id", "n", "fp").join(reach, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one document of each component: the one with the smallest id. Of repeated rows of one id one stays."""
    kept = near_duplicates(docs, id_col=id_col, **options).filter("kept").select(id_col).distinct()
    alone = docs.filter(F.col(id_col).isNull())
    w = Window.partitionBy(id_col).orderBy(*[F.xxhash64(*docs.columns)])
    nth = "__nth"
    stay = docs.join(kept, id_col, "left_semi").withColumn(nth, F.row_number().over(w)).filter(f"{nth} = 1").select(*docs.columns)
    return stay.unionByName(alone)
