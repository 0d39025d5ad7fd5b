"""SQL for the trie, the manifest and the shards."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _crc_table() -> list[int]:
    """The steps of CRC-32 (reflected polynomial EDB88320) for four bits at a time."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a text's UTF-8 bytes: over half bytes, the low one of each byte first."""
    halves = f"string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), '')"
    numbers = f"list_transform({halves}, lambda q: CAST(strpos('0123456789ABCDEF', q) - 1 AS BIGINT))"
    step = f"lambda a, b: xor(a >> 4, ({_crc_table()})[CAST(xor(a, b) & 15 AS INT) + 1])"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {numbers}), {step}), 4294967295) END"


_SPACED = r"[^\x20\x09-\x0D]+"
SQL_OP11 = rf"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32('CAST(conv_id AS VARCHAR)')} % 4 AS h, conv_id - conv_id % 20 AS head FROM (SELECT DISTINCT conv_id FROM o)),
g AS (SELECT c.conv_id, 0 AS side, p, role, text FROM c JOIN o ON o.conv_id = c.head AND p <= h UNION ALL SELECT c.conv_id, 1, p, role, text FROM c JOIN o USING (conv_id) WHERE p > h),
s AS (SELECT c.conv_id, coalesce(list(struct_pack(r := role, t := text) ORDER BY side, p) FILTER (role IS NOT NULL), []) AS s FROM c LEFT JOIN g USING (conv_id) GROUP BY ALL),
m AS (SELECT conv_id, d, s[1:d] AS k, d = len(s) AS ends FROM s, unnest(range(0, len(s) + 1)) AS u(d)),
n AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[-1].t, '{_SPACED}')) END AS own FROM m GROUP BY k, d),
f AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (k)),
a AS (SELECT v.k[1:e] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM v, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
SELECT v.conv_id, d AS depth, q.conv_id AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM v JOIN a USING (k) LEFT JOIN (SELECT k AS up, conv_id FROM n) q ON d > 0 AND q.up = v.k[1:d - 1]
"""


def _field(x: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(x) for x in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _tree(base: str, p: str, levels: int) -> str:
    """CTEs {p}0 .. of the levels above base (tree, i, n, h), 16 nodes a run: (tree, i, n, h), and {p}k with all of them by level (lv)."""
    out = [f"{p}0 AS MATERIALIZED ({base})"]
    for k in range(levels):
        out.append(f"{p}{k + 1} AS MATERIALIZED (SELECT tree, i // 16 AS i, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {p}{k} GROUP BY tree, i // 16)")
    return ",\n".join(out)


def _climb(rows: str, p: str, q: str, levels: int) -> str:
    """CTEs {q}0 .. that carry rows (tree, i, f, proof, ...) up the levels {p}: f folds, proof grows by the siblings."""
    out = [f"{q}0 AS ({rows})"]
    for k in range(levels):
        near = "(SELECT x.tree, x.i, any_value(x.n) AS n, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS b, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS a FROM {t} x JOIN {t} y ON x.tree = y.tree AND x.i // 16 = y.i // 16 GROUP BY x.tree, x.i)".format(t=f"{p}{k}")
        out.append(f"{q}{k + 1} AS MATERIALIZED (SELECT r.* EXCLUDE (i, f, proof), r.i // 16 AS i, CASE WHEN s.n = 1 THEN f ELSE sha256(b || f || a) END AS f, proof || b || a AS proof FROM {q}{k} r JOIN {near} s ON r.tree = s.tree AND r.i = s.i)")
    return ",\n".join(out)


#: Levels that the SQL unrolls: 16^6 rows of a source, 16^4 sources.
_UP, _TOP = 6, 4
SQL_OP12 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce('+' || source, '') AS tree, {_leaf('text')} AS leaf, CASE WHEN ({crc32("CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR)")}) % 5 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {_leaf('text')} END AS f FROM documents),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_tree("SELECT tree, i, n, leaf AS h FROM e", "a", _UP)},
r AS MATERIALIZED (SELECT tree AS src, row_number() OVER (ORDER BY encode(tree)) - 1 AS j, count(*) OVER () AS n, h FROM a{_UP}),
{_tree("SELECT 0 AS tree, j AS i, n, h FROM r", "b", _TOP)},
{_climb("SELECT doc_id, leaf, tree, i, f, '' AS proof FROM e", "a", "p", _UP)},
{_climb(f"SELECT doc_id, leaf, r.h AS subroot, 0 AS tree, r.j AS i, f, proof FROM p{_UP} p JOIN r ON p.tree = r.src", "b", "q", _TOP)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM q{_TOP} JOIN (SELECT h FROM b{_TOP}) ON true
"""

SQL_OP13 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, sha256(coalesce(text, '')) AS digest, {crc32("coalesce(text, '')")} AS crc FROM documents),
g AS (SELECT digest, sum(size) AS size FROM d GROUP BY digest),
k AS MATERIALIZED (SELECT digest, size, CASE WHEN size * 16384 >= (SELECT sum(size) FROM d) THEN '0' || digest ELSE '1' || lpad(CAST(CAST('0x' || digest[1:8] AS BIGINT) % 16384 AS VARCHAR), 10, '0') END AS key FROM g),
items AS MATERIALIZED (SELECT key, row_number() OVER (ORDER BY sum(size) DESC, key) AS i, CAST(sum(size) AS BIGINT) AS size FROM k GROUP BY key),
lpt AS (SELECT CAST(0 AS BIGINT) AS i, '' AS key, 0 AS shard, list_transform(range(16), lambda x: CAST(0 AS BIGINT)) AS loads
  UNION ALL SELECT items.i, items.key, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + items.size ELSE x END)
  FROM lpt JOIN items ON items.i = lpt.i + 1)
SELECT doc_id, CAST(d.size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, digest) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM d JOIN k USING (digest) JOIN lpt USING (key)
"""

ORACLES = {"op11_prefix_trie": SQL_OP11, "op12_merkle_manifest": SQL_OP12, "op13_shards": SQL_OP13}
