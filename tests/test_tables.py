"""Committed versions, checks that ride on writes, and series dealt by range."""

import datetime as dt
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodmark.functions.counts import RangeCounts, window_shares
from floodmark.operators import clean as K
from floodmark.operators import joins as J
from floodmark.operators import ranges as G
from floodmark.operators import selection, sliding
from floodmark.operators import similarity as M
from floodmark.operators import windows as W
from floodmark.sources import sinks
from floodmark.sources.paths import ChecksFailed, write_checked
from floodmark.sources.versions import Conflict, Versions, merge_partitions, month_of
from floodmark.streaming import bars as B

D = dt.date
KEYS = ["series_id", "date"]
BAR = "series_id string, date date, open double, high double, low double, close double"


def bar(day, close=10.0, series="A"):
    return (series, day, 10.0, 11.0, 9.0, close)


def bars(spark, *rows):
    return spark.createDataFrame(list(rows), BAR)


def closes(df):
    return {(r.series_id, r.date): r.close for r in df.collect()}


# --- versions ---------------------------------------------------------------------


def test_replay_after_compaction_keeps_every_bar(spark, tmp_path):
    table = B.bar_table(spark, str(tmp_path / "t"))
    table.merge(bars(spark, bar(D(2024, 1, 2)), bar(D(2024, 1, 3))), batch=0)
    last = bars(spark, bar(D(2024, 1, 3), 10.5), bar(D(2024, 2, 1)))
    table.merge(last, batch=1)
    want = closes(table.read())
    table.compact()
    again = table.merge(last, batch=1)  # foreachBatch may run a batch twice
    assert again["number"] == 3 and closes(table.read()) == want and len(want) == 3
    assert closes(table.read(1)) == {("A", D(2024, 1, 2)): 10.0, ("A", D(2024, 1, 3)): 10.0}  # versions stay as they were
    table.merge(bars(spark, bar(D(2024, 2, 1), 10.7)), batch=2)
    assert closes(table.read())["A", D(2024, 2, 1)] == 10.7


def test_failure_between_files_and_manifest(spark, tmp_path, monkeypatch):
    table = B.bar_table(spark, str(tmp_path / "t"))
    table.merge(bars(spark, bar(D(2024, 1, 2))), batch=0)
    new = bars(spark, bar(D(2024, 1, 2), 10.9), bar(D(2024, 1, 5)))
    publish = Versions._publish
    monkeypatch.setattr(Versions, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.merge(new, batch=1)
    with pytest.raises(OSError, match="lost"):
        table.compact()
    monkeypatch.setattr(Versions, "_publish", publish)
    assert closes(table.read()) == {("A", D(2024, 1, 2)): 10.0}
    table.merge(new, batch=1)
    assert closes(table.read()) == {("A", D(2024, 1, 2)): 10.9, ("A", D(2024, 1, 5)): 10.0}
    folders = lambda: len(list(Path(tmp_path / "t/data").glob("*/part=*")))
    assert folders() == 4
    table.vacuum(keep=1)
    assert folders() == 1 and len(table.numbers()) == 1 and len(closes(table.read())) == 2


def test_a_number_is_given_once(spark, tmp_path):
    table = B.bar_table(spark, str(tmp_path / "t"))
    first = table.merge(bars(spark, bar(D(2024, 1, 2))))
    with pytest.raises(Conflict):
        table._publish({**first, "kind": "late"})
    assert table.manifest()["kind"] == "merge" and table.numbers() == [1]
    there = [p for p in Path(tmp_path / "t/manifests").iterdir() if not p.name.endswith(".crc")]
    assert [json.loads(p.read_text())["number"] for p in there] == [1]


def test_a_merge_that_lost_its_number_runs_over_the_newer_version(spark, tmp_path, monkeypatch):
    table = B.bar_table(spark, str(tmp_path / "t"))
    other = B.bar_table(spark, str(tmp_path / "t"))
    publish, calls = Versions._publish, []

    def late(self, manifest):
        if self is table and not calls:
            calls.append(1)
            other.merge(bars(spark, bar(D(2024, 1, 3), 9.5)), batch=0, source="other")
        return publish(self, manifest)

    monkeypatch.setattr(Versions, "_publish", late)
    known = table.merge(bars(spark, bar(D(2024, 1, 2))), batch=5)
    assert known["number"] == 2 and known["applied"] == {"other": 0, "": 5}
    assert closes(table.read()) == {("A", D(2024, 1, 2)): 10.0, ("A", D(2024, 1, 3)): 9.5}


def test_only_touched_partitions_are_read_and_written(spark, tmp_path):
    table = B.bar_table(spark, str(tmp_path / "t"))
    first = table.merge(bars(spark, *[bar(D(2024, m, 2)) for m in range(1, 13)]))
    second = table.merge(bars(spark, bar(D(2024, 3, 2), 10.5), bar(D(2024, 3, 9))))
    changed = {p for p, f in second["folders"].items() if first["folders"][p] != f}
    assert changed == {"part=2024-03"} and len(second["folders"]) == 12
    made = second["folders"]["part=2024-03"].rpartition("/")[0]
    assert [p.name for p in Path(tmp_path / "t" / made).iterdir() if p.is_dir()] == ["part=2024-03"]
    assert {f.split("/")[-2] for f in table.read(parts=["part=2024-03"]).inputFiles()} == {"part=2024-03"}
    assert closes(table.read(parts=["part=2024-03"])) == {("A", D(2024, 3, 2)): 10.5, ("A", D(2024, 3, 9)): 10.0}


def test_batches_and_units_are_rejected_whole(spark, tmp_path):
    table = B.bar_table(spark, str(tmp_path / "t"))
    table.merge(bars(spark, bar(D(2024, 1, 2)), bar(D(2024, 1, 3))), batch=0)
    keep = closes(table.read())
    day = lambda k: F.lit(D(2024, 1, k))
    for rows, word in (([bar(D(2024, 1, 3)), bar(D(2024, 1, 4), 0.0)], "invalid 1"), ([bar(D(2024, 1, 3)), bar(D(2024, 1, 3), 10.2)], "repeated 1"), ([bar(D(2024, 1, 2))], "lost 1"), ([bar(D(2024, 1, 3)), bar(D(2024, 2, 4), series="B")], "cold 1")):
        with pytest.raises(ChecksFailed, match=word):
            table.merge(bars(spark, *rows), whole=True, overlap_from=day(3), start=day(5), rejected="raise")
        assert closes(table.read()) == keep
    assert table.manifest()["number"] == 1
    assert table.merge(bars(spark, bar(D(2024, 1, 4), 0.0)), batch=1, whole=True)["kind"] == "rejected"
    assert closes(table.read()) == keep and table.manifest()["applied"] == {"": 1}
    mixed = bars(spark, bar(D(2024, 1, 5)), bar(D(2024, 1, 6), -1.0), bar(D(2024, 1, 5), series="B"), bar(D(2024, 1, 8), series="C"), bar(D(2024, 1, 8), 10.1, series="C"))
    table.merge(mixed, batch=2, unit=["series_id"])
    assert closes(table.read()) == {**keep, ("B", D(2024, 1, 5)): 10.0}
    told = {(r.series_id, r.date.day, r.reason) for r in table.rejects().filter("series_id <> 'A' or date > '2024-01-04'").collect()}
    assert told == {("A", 5, "batch_rejected"), ("A", 6, "bad_close"), ("C", 8, "batch_rejected")}


def test_odd_batches(spark, tmp_path):
    table = B.bar_table(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no version"):
        table.read()
    assert table.merge(bars(spark, bar(D(2024, 1, 2))).filter("false"), batch=0)["number"] == 1
    assert table.read().count() == 0
    table.merge(bars(spark, bar(None), bar(D(2024, 1, 2)), bar(D(2024, 1, 2), 10.4)), batch=1)
    assert closes(table.read()) == {("A", None): 10.0, ("A", D(2024, 1, 2)): 10.4}  # of two bars the greater


def test_partitions_of_a_plain_table(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: bars(spark, *x).withColumn("month", month_of())
    merge_partitions(path, rows(bar(D(2024, 1, 2)), bar(D(2024, 2, 2))), [*KEYS, "month"], "month")
    before = {p: p.stat().st_mtime_ns for p in Path(path).glob("month=2024-01/*.parquet")}
    merge_partitions(path, rows(bar(D(2024, 2, 2), 10.5), bar(D(2024, 3, 1))), [*KEYS, "month"], "month")
    assert {p: p.stat().st_mtime_ns for p in Path(path).glob("month=2024-01/*.parquet")} == before
    assert closes(spark.read.parquet(path)) == {("A", D(2024, 1, 2)): 10.0, ("A", D(2024, 2, 2)): 10.5, ("A", D(2024, 3, 1)): 10.0}


# --- checks that ride on writes ------------------------------------------------------


def test_nothing_is_published_where_a_check_fails(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(ChecksFailed, match="odd 3.*1 to 5") as e:
        write_checked(spark.range(6), path, {"odd": F.col("id") % 2 == 1, "large": F.col("id") > 9}, told=F.col("id").cast("string"))
    assert e.value.counts == {"odd": 3} and list(tmp_path.iterdir()) == []
    assert write_checked(spark.range(6), path, {"large": F.col("id") > 9})["rows"] == 6
    assert spark.read.parquet(path).count() == 6


def counting(path):
    """A function over doubles that notes each call."""

    def note(x):
        with open(path, "ab") as f:
            f.write(b".")
        return x

    return F.udf(note, "double")


def test_strict_join_runs_its_input_once(spark, tmp_path):
    from floodmark.plans import demo

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("the given tables are not here")
    left, right = demo.positions(spark, sf).select("series_id", "date", "oi"), demo.prices(spark, sf).select("series_id", "date", "close")
    with pytest.raises(ValueError, match="no price within tolerance: unmatched"):
        J.asof_strict(left, right, ["close"])
    rows = [("A", D(2024, 1, k), float(k)) for k in range(1, 31)]
    few = spark.createDataFrame(rows, "series_id string, date date, oi double").withColumn("oi", counting(tmp_path / "calls")("oi"))
    out = J.asof_strict(few, spark.createDataFrame(rows, "series_id string, date date, close double"), ["close"])
    assert out.count() == 30 and (tmp_path / "calls").stat().st_size == 30


def test_merge_gate_runs_both_sides_once(spark, tmp_path):
    old, new = bars(spark, bar(D(2024, 1, 1)), bar(D(2024, 1, 2))), bars(spark, bar(D(2024, 1, 2), 10.5), bar(D(2024, 1, 3)))
    f = counting(tmp_path / "calls")
    out = K.merge_checked(old.withColumn("open", f("open")), new.withColumn("open", f("open")), KEYS, F.lit(D(2024, 1, 2)), F.lit(D(2024, 1, 2)), F.lit(D(2024, 1, 1)))
    assert closes(out) == {("A", D(2024, 1, 1)): 10.0, ("A", D(2024, 1, 2)): 10.5, ("A", D(2024, 1, 3)): 10.0}
    assert (tmp_path / "calls").stat().st_size == 4


# --- series by range --------------------------------------------------------------


@pytest.fixture
def ranged(spark):
    """Small tables in several ranges, as large ones are."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 3 else f"s{i % 4}" if i % 5 else None, int(rng.integers(0, 900)), i, float(rng.integers(0, 40)) if i % 11 else None) for i in range(4000)]
    rows += [("hot", 450, 4000 + i, 7.0) for i in range(500)]  # equal values over several ranges
    return spark.createDataFrame(rows, "series_id string, date int, id int, x double").repartition(7).cache()


def test_positions_by_range(ticks, ranged):
    w = W.Window.partitionBy("series_id").orderBy("date", "id")
    want = ticks.select("id", (F.row_number().over(w) - 1).cast("long").alias("p")).collect()
    assert sorted(G.positions(ticks, ["date", "id"], "p").select("id", "p").collect()) == sorted(want)


def test_ranks_by_range(ticks, ranged):
    want = ticks.filter("x is not null").withColumn("r", W.average_rank("x", ["series_id"])).withColumn("s", W.percent_rank_average("x", ["series_id"])).select("id", "r", "s")
    got = G.ranks(ticks, "x", rank="r", percent="s")
    assert sorted(got.filter("x is not null").select("id", "r", "s").collect()) == sorted(want.collect())
    assert got.filter("x is null and r is null and s is null").count() == ticks.filter("x is null").count() > 0
    assert G.ranks(ticks.filter("false"), "x").count() == 0


def test_asof_by_range(spark, ticks, ranged):
    left = ticks.filter("id % 3 <> 1").select("series_id", F.date_add(F.lit(D(2020, 1, 1)), F.col("date")).alias("date"), "id")
    right = ticks.filter("id % 3 = 1").groupBy("series_id", F.date_add(F.lit(D(2020, 1, 1)), F.col("date")).alias("date")).agg(F.max("x").alias("x"))
    few = right.filter("date < '2020-02-10' or date > '2021-12-01'")  # nothing for many ranges on end
    for r in (right, few, right.filter("false")):
        want = J.asof(left, r, ["x"], tolerance_days=400)
        got = G.asof(left, r, ["x"], within=F.datediff("date", "asof_date") <= 400)
        assert got.columns == want.columns
        key = lambda rows: sorted(tuple(map(str, x)) for x in rows)
        assert key(got.collect()) == key(want.collect())


def test_a_hot_series_is_in_several_ranges(ticks, ranged):
    laid = G._laid(ticks, ["series_id"], ["date"])
    assert laid.filter("series_id = 'hot'").select("__range").distinct().count() > 1


# --- order statistics ---------------------------------------------------------------


def test_counts_of_stretches():
    rng = np.random.default_rng(1)
    for top in (1, 2, 7, 8, 300):
        codes = rng.integers(0, top, 500)
        left = rng.integers(0, 501, 400)
        right = np.maximum(left, rng.integers(0, 501, 400))
        bound = rng.integers(0, top + 1, 400)
        want = [(codes[a:b] < k).sum() for a, b, k in zip(left, right, bound, strict=True)]
        assert RangeCounts(codes).below(left, right, bound).tolist() == want
    assert RangeCounts(np.zeros(0, np.int64)).below(np.zeros(2, int), np.zeros(2, int), np.array([0, 3])).tolist() == [0, 0]


def plain_share(v, i, size, inclusive, least):
    window = [x for x in v[max(i - size + inclusive, 0) : i + inclusive] if not np.isnan(x)]
    own = (window[-1] if window else np.nan) if inclusive else v[i]
    return sum(x <= own for x in window) / len(window) if len(window) >= max(least, 1) and not np.isnan(own) else np.nan


@pytest.mark.parametrize("inclusive", [False, True])
def test_window_shares(inclusive):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=300), 1)
    v[rng.random(300) < 0.2] = np.nan
    v[:20] = np.nan
    for values in (v, np.full(50, np.nan), np.ones(40), np.array([])):
        got = window_shares(values, {n: (n, inclusive) for n in (1, 7, 90, 1000)}, 3)
        for n, shares in got.items():
            assert shares.tolist() == pytest.approx([plain_share(values, i, n, inclusive, 3) for i in range(len(values))], nan_ok=True)


@pytest.mark.parametrize("inclusive", [False, True])
def test_sliding_percentiles_over_chunks(spark, ranged, inclusive):
    rng = np.random.default_rng(3)
    rows = [(s, i, None if rng.random() < 0.1 else float(rng.integers(0, 30)), f"{s}{i}") for s, n in (("a", 900), ("b", 5), ("c", 130)) for i in range(n)]
    df = spark.createDataFrame(rows, "series_id string, date int, x double, kept string").repartition(5)
    w = W.by_series()
    column = W.percentile if inclusive else W.prior_percentile
    want = df.select("kept", column("x", 60, 10, w).alias("s60"), column("x", 7, 10, w).alias("s7"), column("x", 100, 10, w).alias("s100")).collect()
    got = sliding.sliding_percentiles(df, "x", {"s60": 60, "s7": 7, "s100": 100}, 10, inclusive=inclusive, rows=64)
    assert sorted(map(str, got.select("kept", "s60", "s7", "s100").collect())) == sorted(map(str, want))
    assert sliding.sliding_percentiles(df.filter("false"), "x", {"s": 5}, 1).count() == 0


def test_cost_of_a_window_does_not_grow_with_it():
    import time

    v = np.random.default_rng(4).normal(size=200_000)
    took = []
    for size in (150, 5000, 100_000):
        began = time.process_time()
        window_shares(v, {"s": (size, False)}, 10)
        took.append(time.process_time() - began)
    assert max(took) < 4 * min(took) + 0.2


def test_quantiles_equal_those_of_buffers(spark):
    rng = np.random.default_rng(6)
    rows = [("normal", float(x)) for x in rng.normal(size=3000)] + [("few", float(x)) for x in rng.integers(0, 3, 2000)] + [("one", 4.5)] * 900
    rows += [("steep", float(10.0 ** -(i % 300))) for i in range(1500)] + [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 1.0, 2.0)] + [("single", -3.0), ("empty", None), ("empty", float("nan")), ("odd", float("inf")), ("odd", 1.0), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    want = {"q0": 0.0, "q1": 0.25, "median": 0.5, "q9": 0.97, "top": 1.0}
    solid = df.withColumn("x", F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x")))
    plain = {r.k: r for r in solid.groupBy("k").agg(F.count("x").alias("n"), *[F.percentile("x", q).alias(c) for c, q in want.items()]).collect()}
    got = {r.k: r for r in selection.quantiles(df, ["k"], "x", want, bins=40, few=100).collect()}
    assert set(got) == set(plain)
    for k, r in plain.items():
        if r.n == 0:
            assert got[k].n == 0 and got[k].median is None
        else:
            assert got[k].n == r.n and [got[k][c] for c in want] == pytest.approx([r[c] for c in want], rel=1e-12, abs=0), k
    pooled = selection.quantiles(df, [], "x", {"median": 0.5}, bins=40, few=100).first()
    assert pooled.median == solid.agg(F.median("x")).first()[0]
    assert selection.quantiles(df.filter("false"), ["k"], "x", want).count() == 0


def test_windows_over_a_clustered_table_need_no_exchange(spark):
    df = spark.createDataFrame([(f"s{i % 9}", D(2024, 1, 1) + dt.timedelta(days=i // 9), float(i * 7 % 31)) for i in range(900)], "series_id string, date date, x double")
    column = W.percentile("x", 50, 10, W.by_series())
    want = sorted(map(str, df.select("series_id", "date", column.alias("p")).collect()))
    with sinks.clustered(df, 4) as table:
        out = table.select("series_id", "date", column.alias("p"))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, out.collect())) == want
        name = table
    with pytest.raises(Exception, match="NOT_EXIST|not exist|NOT_FOUND|cannot be found"):
        name.count()


# --- nearest states across series ------------------------------------------------------


def test_nearest_states_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(25):
        base = rng.random(3) if k else np.array([5.0, 5.0, 5.0])  # one series is far from all others
        rows += [(f"s{k}", D(2020, 1, 1) + dt.timedelta(days=i), *[float(round(x, 2)) for x in base + rng.normal(scale=0.1, size=3)]) for i in range(60)]
    rows += [("s3", D(2021, 1, 1), None, 0.1, 0.2)]  # no complete row: not a state
    df = spark.createDataFrame(rows, "series_id string, date date, a double, b double, c double")
    full = [r for r in rows if r[2] is not None]
    want = set()
    for q in {r[0] for r in full}:
        now = max((r for r in full if r[0] == q), key=lambda r: r[1])
        far = lambda r: (abs(r[2] - now[2]) + abs(r[3] - now[3]) + abs(r[4] - now[4])) * 100  # noqa: B023, E731
        best = sorted((-np.floor((100 - min(far(r) / 3, 100)) * 1e10 + 0.5), r[1], r[0], far(r)) for r in full if r[0] != q)[:7]
        want |= {(q, f, t, i + 1) for i, (_, t, f, _) in enumerate(best)}
    got = M.similar_states_across(df, ["a", "b", "c"], top=7)
    assert {(r.query, r.found, r.date, r.rank) for r in got.collect()} == want
    assert M.similar_states_across(df.filter("false"), ["a", "b", "c"]).count() == 0
    two = df.filter("series_id in ('s1', 's2') and date < '2020-01-04'")  # fewer rows than asked for
    assert M.similar_states_across(two, ["a", "b", "c"], top=7).count() == 6


def test_pairs_looked_at_stay_far_below_all(spark):
    n, m = 200, 300
    df = spark.range(n * m).select((F.col("id") % n).cast("string").alias("found"), *[F.rand(k).alias(c) for k, c in enumerate("abc")])
    asked = df.dropDuplicates(["found"]).withColumnRenamed("found", "query")
    radius = (2 * 20 / (n * m)) ** (1 / 3)
    pairs = M._near_pairs(asked, df, ["a", "b", "c"], radius)
    assert pairs.count() < 0.05 * n * n * m
    assert pairs.filter(F.col("distance") <= 100 * radius).count() == asked.crossJoin(df.withColumnsRenamed({c: c * 2 for c in "abc"})).filter(f"query <> found and (abs(a - aa) + abs(b - bb) + abs(c - cc)) * 100 <= {100 * radius!r}").count()


# --- bar ends on a stream ----------------------------------------------------------------


def test_bar_ends_of_a_stream_in_batches(spark, tmp_path):
    rng = np.random.default_rng(12)
    base, schema = dt.datetime(2024, 1, 2), "series_id string, ts timestamp"
    stamps = sorted({(base + dt.timedelta(seconds=int(x) * (60 if i % 3 else 1)), f"s{i % 2}") for i, x in enumerate(rng.integers(0, 900, 500))} | {(base + dt.timedelta(hours=k), "lone") for k in (1, 5)})
    for k in range(4):  # in time order, a file a batch; some stamps come twice
        part = [(s, t) for t, s in stamps[max(0, k * 130 - 5) : (k + 1) * 130]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "stamps"))
    got = B.replay_bar_ends(spark, str(tmp_path / "stamps"), "2024-01-02 04:30:00", files=1).collect()
    seen = stamps[:520]
    past = max(t for t, _ in seen) - dt.timedelta(minutes=10)
    want = set()
    for t, s in seen:
        later = [u for u, o in seen if o == s and u > t and u.second == 0]
        end = min([t + dt.timedelta(hours=1), dt.datetime(2024, 1, 2, 4, 30), *later])
        if end <= past and t < past:
            want.add((s, t, end))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
