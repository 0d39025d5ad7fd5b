"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, forest, langid, manifest, neardup, oracles, quality, secrets, shards, tokenids, toxicity, trie, warc
from .common import crc_mod, scratch, stored, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    parser = langid.fit_cross_parser(docs.filter(~F.col("held_out")))
    return langid.identify_language(docs.select("doc_id", "held_out", "text"), parser).drop("text")


def _labelled(spark: SparkSession, sf_dir: str, label: str, n: int, held: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """The documents with held_out, and a bounded sample of rows whose labels may be learnt from.

    The sample is drawn from the narrow table of labels, so that texts are not
    shuffled; its 2 * rows ids at most are broadcast.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", n) == held).alias("held_out"))
    ids = table(spark, sf_dir, "labels").select("doc_id", label).filter(crc_mod("doc_id", n) != held)
    pick = lambda y: ids.filter(F.col(label) == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs, docs.join(F.broadcast(pick(0).union(pick(1))), "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, train = _labelled(spark, sf_dir, "toxic", 3, 1, toxicity.SAMPLE_ROWS)
    model = toxicity.fit_toxicity(train)
    found = toxicity.score_toxicity(docs, model)
    spans = F.array_join(F.transform("toxic_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), spans.alias("toxic_spans"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of the archives of all pages; the second has pages with ids of 13 modulo 97 damaged by one byte."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = F.concat(F.lit("pages-"), F.floor(F.col("page_id") / warc.ARCHIVE_RECORDS).cast("string"), F.lit(".warc"))
    hurt = F.col("page_id") % 97 == 13
    # what was written down (lengths, digests) stays as it was: only the last byte of the body changes
    whole = warc.record_bytes(F.col("url"), F.col("html"))
    other = F.concat(F.substring(whole, F.lit(1), F.octet_length(whole) - 5), F.lit("#\r\n\r\n").cast("binary"))
    broken = F.when(hurt, other).otherwise(whole)
    sides = [stored(warc.placed_leaves(pages, id_col="page_id", archive=archive, bytes_=b), "leaves") for b in (whole, broken)]
    return warc.audit(*sides).select(F.col("a_id").alias("page_id"), "archive", F.col("a_offset").alias("start"), "a_length", "b_length")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, train = _labelled(spark, sf_dir, "quality", 5, 0, quality.SAMPLE_ROWS)
    model = quality.fit_quality(train)
    found = quality.score_quality(docs, model)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs, secrets.fit_markov(docs))
    return found.select(
        "doc_id", *[secrets.count_kind(k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(secrets.joined("base_spans").cast("binary"), 256).alias("base_sha256"), secrets.joined("spans").alias("spans"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


def op7_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    tokenids.write_token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end_id=2, added=True)
    return tokenids.read_token_file(spark, path, digests=True)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), digests=True).drop("text")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = decontam.n_hit()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, lengths = trie.graft_heads(trie.turns_of(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns, lengths).drop("name", "parent")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ids whose crc32 five divides are lower-cased after the manifest is made; the proofs tell which rows that changed."""
    low = F.translate("text", oracles.UPPER, oracles.UPPER.lower())
    root, rows = manifest.manifest(table(spark, sf_dir, "documents"), seen=F.when(crc_mod("doc_id", 5) == 0, low).otherwise(F.col("text")))
    proof = manifest.digest(manifest.proof_text(F.col("path")))
    found = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), F.col("folded").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shard_documents(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n FROM d, sizes WHERE len(w) >= n), unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT r, g.n, i, item_id FROM g JOIN win ON g.n = win.n AND g.g = win.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

SQL_OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(least(m, doc_id), doc_id) AS component_id, doc_id = coalesce(least(m, doc_id), doc_id) AS kept
FROM n LEFT JOIN m ON m.a = n.doc_id
"""

SQL_OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT * FROM ok WHERE n > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.9 * x.n * y.n),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a),
k AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(least(m, vec_id), vec_id) AS component_id, vec_id = coalesce(least(m, vec_id), vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.a = vec_id LEFT JOIN k ON k.a = vec_id
"""

_HEAD = "octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:')) + 64 + octet_length(encode(chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(encode(coalesce(html, ''))) AS VARCHAR))) + 4 + octet_length(encode(coalesce(html, ''))) + 4"

SQL_OP3 = f"""
WITH p AS (SELECT page_id, 'pages-' || CAST(page_id // 4096 AS VARCHAR) || '.warc' AS archive, CAST({_HEAD} AS BIGINT) AS n FROM pages),
o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p)
SELECT page_id, archive, start, n AS a_length, n AS b_length FROM o WHERE page_id % 97 = 13
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_quality": op4_quality,
    "op5_secrets": op5_secrets,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_embedding_near_duplicates": op7_embedding_near_duplicates,
    "op8_token_ids": op8_token_ids,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_shards": op13_shards,
}
ORACLES: dict[str, str] = {**oracles.ORACLES, "op3_warc_fixity": SQL_OP3, "op7_embedding_near_duplicates": SQL_OP7, "op6_near_duplicates": SQL_OP6, "op10_decontamination": SQL_OP10}
