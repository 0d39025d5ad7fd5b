"""Registered queries against their SQL on the smallest tables, and that the entry points hold together."""

import math
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
SOME = ("rolling_percentile", "factor_bucket_split", "structure_outcomes", "velocity_train_test", "signal_train_test", "similar_states", "dedupe_events", "asof_price_strict", "week_outcome", "extreme_details", "incremental_merge", "stream_bars", "incremental_merge_gate", "release_status", "outcome_rules", "archive_merge", "coverage_diagnosis", "hub_summary",
        "versioned_bars", "partition_merge", "stream_upsert_deliveries", "stream_bar_ends", "asof_hot_series", "ranks_hot_series", "sliding_percentile_hot", "pooled_quantiles", "clustered_windows", "complete_bar_gate",
        "validate_cases", "validate_summary", "hub_health", "source_audit_classes", "calendar_evidence", "calendar_week_sources", "interpretation_text", "similar_states_across")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if isinstance(v, int | str | bool | None.__class__) else str(v)[:19].replace(" 00:00:00", "")


@pytest.mark.skipif(not SF.exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    table = con.execute(entry.oracle_sql()[name]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in table)
    assert got == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.skipif(not SF.exists(), reason="the given tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_does_not_import_the_corpus_folder():
    root = Path(entry.__file__).parent / "floodmark"
    for d, _, files in os.walk(root):
        if "llm" not in Path(d).parts:
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in (Path(d) / f).read_text()
