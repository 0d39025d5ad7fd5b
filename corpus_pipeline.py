"""A corpus through five stages: toxicity, near duplicates, test items, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last
returns their token ids. ``run`` writes each stage's result to the shared folder
and reads it again.

Defined results, in every stage: a null text stays null (and is encoded as an
empty one), an empty text is kept; rows without an id are kept; of rows with one id
one stays after the second stage; an empty table gives an empty table; extra
columns pass through unchanged, whatever their names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodmark.llm import bpe, decontam, neardup, secrets, toxicity
from floodmark.llm.common import crc_mod, stored, table

#: A document goes from this toxicity on.
TOXIC = 0.7
#: A document goes if more than this share of its words stands in test items; otherwise only those words go.
COVERAGE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC. Learns from the labelled rows of documents that may be learnt from, scores what it is given."""
    ids = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod("doc_id", 3) != 1)
    pick = lambda y: ids.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxicity.SAMPLE_ROWS)
    train = table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(pick(0).union(pick(1))), "doc_id")
    # the row goes as one column, so that no column of docs has the name of a result
    rows = docs.select(F.struct("*").alias("row"))
    return toxicity.score_toxicity(rows, toxicity.fit_toxicity(train), text_col="row.text", spans=False).filter(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id: five-word shingles, a similarity of 0.8 or more."""
    return neardup.deduplicate(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what stands in test items out of texts; a document goes if that is more than COVERAGE of its words."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=COVERAGE)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; the models are trained on the documents given. Keeps all documents."""
    return secrets.redact(docs, secrets.fit_markov(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of every document given."""
    out = bpe.encode_texts(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "n_tokens", "token_ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_test_items),
    ("secrets", redact_secrets),
    ("tokens", encode),
]

#: SQL has no form of the fitted models and of the token ids; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, on the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
