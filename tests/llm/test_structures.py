"""Prefix trie, Merkle manifest and shards: plain versions, SQL over the given tables, odd tables."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from floodmark.llm import manifest, oracles, order, queries, shards, trie

SF = Path("/root/testdata/sf0.001")
given = pytest.mark.skipif(not SF.exists(), reason="the given tables are not here")


@pytest.fixture(autouse=True)
def ranged(spark):
    """Small tables in several ranges, as large ones are."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


H = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


@given
@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rows = con.execute(queries.ORACLES[name]).fetchall()
    cols = [d[0] for d in con.description]
    got = queries.QUERIES[name](spark, str(SF))
    assert sorted(got.columns) == sorted(cols)
    assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(rows)


# --- positions ----------------------------------------------------------------------


def test_positions_of_a_hot_key_and_equal_rows(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randrange(50)) for _ in range(3000)] + [(f"k{i % 90}", None if i % 7 == 0 else i) for i in range(600)] + [("same", 5)] * 400
    df = spark.createDataFrame(rows, "k string, v long").repartition(9)
    got = order.kept_numbered(df, ["k"], ["v"], "at", "n").collect()
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    by = defaultdict(dict)
    for r in got:
        assert r.at not in by[r.k]
        by[r.k][r.at] = r.v
    for k, vs in want.items():
        assert [by[k][i] for i in range(len(vs))] == sorted(vs, key=lambda v: (v is not None, v or 0))
    assert {(r.k, r.n) for r in got} == {(k, len(v)) for k, v in want.items()}
    assert order.numbered(df.filter("false"), ["k"], ["v"], "at").count() == 0


# --- trie ---------------------------------------------------------------------------

CONV = "conv_id long, turn long, role string, text string, seq string, name string, d string"


def plain_trie(rows):
    """rows (conv, turn, role, text): the contract of op11, in plain Python."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append(((t is not None, t or 0), H(f"{len(r.encode())}:{r}{x}"), r, x))
    convs = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: y[:2])] for c, v in convs.items()}
    rem = lambda c: c - 20 * int(c / 20)  # noqa: E731  the sign of c, as in SQL
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(convs.get(c - rem(c), [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in made.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], H(",".join(map(str, sorted(ends[k]))))) for k, m in members.items())


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CONV)
    turns, lengths = trie.graft_heads(trie.turns_of(df))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in trie.prefix_trie(turns, lengths).select(cols).collect())


def test_trie_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)  # ends of one node in several rows
    rng = random.Random(4)
    rows = []
    for c in [*range(90), 2019, 2021, -3, -20, -41]:
        same = random.Random(c % 3)
        for t in range(rng.choice([1, 2, 3, 3, 4, 7, 8])):
            rows.append((c, t, same.choice(["user", "assistant"]), " ".join(same.choice("ab") for _ in range(same.randrange(4)))))
    rows += [(700, 0, "user", "alone")]  # a sequence that may lose its only turn
    rows += [(801, None, "user", "first"), (801, 1, None, None), (801, 1, None, None), (801, 1, "b", ""), (None, 1, "user", "of no conversation")]
    rows += [(803, 3, "u", "tie b"), (803, 3, "u", "tie a"), (803, 3, "u", "tie a")]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_long_and_single_sequences(spark):
    rows = [(c, t, "user", f"turn {t if t < c - 2 else -c} \t\n word") for c in (20, 21, 22) for t in range(36)]
    rows.append((40, 0, "user", "long " * 100_000))
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_sequences(spark):
    df = spark.createDataFrame([], CONV)
    turns, lengths = trie.graft_heads(trie.turns_of(df))
    assert trie.prefix_trie(turns, lengths).count() == 0
    gone = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(gone, 0, "user", "its head is absent")]
    assert trie_rows(spark, rows) == plain_trie(rows) == Counter([(gone, 0, None, 1, 0, 1, 0, H(str(gone)))])


# --- manifest -------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, hash string, number string"


def f(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows, fanout, changed):
    """rows (doc_id, text, lang, source, n_chars): {row number: (leaf, subroot, proof, folded)} and the root."""
    leaf = lambda r, text: H("".join(map(f, (r[0], r[3], r[2], r[4], text))))
    first = lambda v: (v is not None, v or 0)

    def up(nodes, climbers):
        """nodes: hashes. climbers: {key: [place, folded, siblings]}."""
        while len(nodes) > 1:
            for c in climbers.values():
                a = c[0] - c[0] % fanout
                left, right = "".join(nodes[a : c[0]]), "".join(nodes[c[0] + 1 : a + fanout])
                c[:] = [c[0] // fanout, H(left + c[1] + right), c[2] + left + right]
            nodes = [H("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        return nodes[0]

    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[r[3]].append((first(r[0]), leaf(r, r[1]), i))
    state, sub = {}, {}
    for s, v in groups.items():
        v.sort()
        state |= (own := {i: [k, leaf(rows[i], changed(rows[i])), ""] for k, (_, _, i) in enumerate(v)})
        sub[s] = up([x[1] for x in v], own)
    names = sorted(sub, key=lambda s: (s is not None, (s or "").encode()))
    for k, s in enumerate(names):
        for _, _, i in groups[s]:
            state[i][0] = k
    root = up([sub[s] for s in names], state)
    return Counter((r[0], leaf(r, r[1]), sub[r[3]], H(state[i][2]), state[i][1]) for i, r in enumerate(rows)), root


@pytest.mark.parametrize(("fanout", "n"), [(16, 700), (2, 90), (3, 100)])
def test_manifest_equals_plain_version(spark, fanout, n):
    rng = random.Random(fanout)
    sources = [None, "", "b", "B", "é", "zz", "hot"]
    rows = [(i * 3 % n, rng.choice([None, "", "Some TEXT", f"Text {i} É"]), rng.choice([None, "en"]), rng.choice(sources) if i % 3 else "hot", rng.choice([None, 0, 12345])) for i in range(n)]
    rows += [(None, "no id", None, "b", 1), (None, "no id either", None, "b", 1), (5, "Twice", "en", "hot", 1), (5, "Twice", "en", "hot", 1), (9, "X" * 300_000, "en", "one leaf", 3)]
    df = spark.createDataFrame([(*r, "q", "q", "q") for r in rows], DOCS)
    seen = F.when(F.col("doc_id") % 4 == 1, F.translate("text", oracles.UPPER, oracles.UPPER.lower())).otherwise(F.col("text"))
    low = str.maketrans(oracles.UPPER, oracles.UPPER.lower())
    want, root = plain_manifest(rows, fanout, lambda r: r[1].translate(low) if r[1] is not None and r[0] is not None and r[0] % 4 == 1 else r[1])
    top, out = manifest.manifest(df, seen=seen, fanout=fanout)
    out = out.select("doc_id", "leaf", "subroot", manifest.digest(manifest.proof_text(F.col("path"))).alias("p"), "folded").collect()
    assert top == root
    assert Counter(map(tuple, out)) == want
    assert {r.folded == root for r in out} == {True, False}


def test_manifest_of_few_rows(spark):
    root, out = manifest.manifest(spark.createDataFrame([], DOCS))
    assert root is None and out.count() == 0
    root, out = manifest.manifest(spark.createDataFrame([(1, None, None, None, None, "", "", "")], DOCS))
    assert [(r.leaf, r.subroot, r.folded, r.path) for r in out.collect()] == [(root, root, root, [])] and root == H("1:1----")


# --- shards ---------------------------------------------------------------------------


def spark_bundle(digest, bundles):
    return int(digest[:8], 16) % bundles


def plain_shards(rows, n, bundles):
    size = Counter()
    for _, t in rows:
        size[H(t or "")] += len((t or "").encode()) + 1
    total = sum(size.values())
    items, of = Counter(), {}
    for d, s in size.items():
        of[d] = (0, d) if s * bundles >= total else (1, f"{spark_bundle(d, bundles):010d}")
        items[of[d]] += s
    loads, where = [(0, k) for k in range(n)], {}
    for key, s in sorted(items.items(), key=lambda x: (-x[1], x[0])):
        load, k = heapq.heappop(loads)
        heapq.heappush(loads, (load + s, k))
        where[key] = k
    return {d: where[key] for d, key in of.items()}


@pytest.mark.parametrize("bundles", [16384, 40])
def test_shards_equal_plain_version(spark, bundles):
    rng = random.Random(bundles)
    texts = [None, "", "é" * 40, *(" ".join(rng.choice("abc") * rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))) for _ in range(400))]
    rows = [(i, rng.choice(texts)) for i in range(900)] + [(i, "a text that a third of all rows hold") for i in range(900, 1350)] + [(None, "no id"), (None, "no id"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(i, t, "en", None, None, "x", "y", "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, shard string, digest string, id string")
    got = shards.shard_documents(df, bundles=bundles).collect()
    where = plain_shards(rows, 16, bundles)
    assert Counter((r.id, r.size, r.text_crc32, r.shard) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), where[H(t or "")]) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, (r.id is not None, r.id or 0)))
    for v in slots.values():
        v.sort()
        assert [x[0] for x in v] == list(range(len(v))) and [x[1] for x in v] == sorted(x[1] for x in v)


def test_loads_are_near_equal(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(i, "x" * rng.randrange(1, 3000)) for i in range(5000)], "doc_id long, text string")
    loads = [r[0] for r in shards.shard_documents(df).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(loads) == 16 and max(loads) - min(loads) <= 64


def test_shards_of_nothing_and_of_files(spark, tmp_path):
    schema = "doc_id long, text string, shard string, size string"
    assert shards.shard_documents(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, f"text {i % 50} " * (i % 7), "kept", "kept") for i in range(300)] + [(None, None, None, None), (1, "y" * 500_000, "kept", "kept")]
    df = spark.createDataFrame(rows, schema)
    told = {r.shard: (r.rows, r.bytes) for r in shards.write_shards(df, str(tmp_path / "out"), files=2).collect()}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.row.doc_id, r.row.text, r.row.shard, r.row.size) for r in back.collect()) == Counter(rows)
    assert sum(n for n, _ in told.values()) == len(rows)
    at = {(r.id, r.text_crc32): r.shard for r in shards.shard_documents(df).collect()}
    assert all(at[r.row.doc_id, zlib.crc32((r.row.text or "").encode())] == r.shard for r in back.collect())
