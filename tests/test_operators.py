"""Small hand-made cases for the positioning operators, against plain Python where that says more."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from floodmark.functions import columns as C
from floodmark.operators import clean as K
from floodmark.operators import joins as J
from floodmark.operators import outcomes as O
from floodmark.operators import quality as Q
from floodmark.operators import similarity as M
from floodmark.operators import stats as S
from floodmark.operators import windows as W
from floodmark.sources import readers as R
from floodmark.sources import sinks
from floodmark.streaming import bars as B

D = dt.date


def weekly(spark, values, series="A", start=D(2020, 1, 7)):
    rows = [(series, start + dt.timedelta(weeks=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, date date, x double")


def column(df, c, keys=("series_id", "date")):
    return [r[c] for r in df.orderBy(*keys).collect()]


def test_inclusive_percentile_uses_last_value_of_a_null_row(spark):
    df = weekly(spark, [3, 1, None, 2])
    out = column(df.withColumn("p", W.percentile("x", 4, 2, W.by_series())), "p")
    assert out == [None, 0.5, 0.5, pytest.approx(2 / 3)]


def test_prior_percentile_and_zscore_exclude_the_row(spark):
    rng = np.random.default_rng(1)
    v = [None if i % 7 == 3 else float(x) for i, x in enumerate(rng.integers(0, 9, 60))]
    df = weekly(spark, v).unionByName(weekly(spark, [100.0] * 30, "B"))
    w = W.by_series()
    out = df.withColumns({"p": W.prior_percentile("x", 20, 5, w), "z": W.zscore("x", 20, 5, w, prior=True)}).filter("series_id = 'A'")
    p, z = column(out, "p"), column(out, "z")
    for i, x in enumerate(v):
        prior = [y for y in v[max(0, i - 20) : i] if y is not None]
        if x is None or len(prior) < 5:
            assert p[i] is None and z[i] is None
        else:
            assert p[i] == pytest.approx(np.mean([y <= x for y in prior]))
            assert z[i] == pytest.approx((x - np.mean(prior)) / np.std(prior, ddof=1))


def test_vectorised_percentile_equals_columns_and_flat_series_has_no_score(spark):
    df = weekly(spark, np.random.default_rng(2).normal(size=80)).unionByName(weekly(spark, [5.0] * 40, "B"))
    a = W.long_window_percentile(df, "x", {"p": 30}, 10)
    b = df.withColumn("p", W.prior_percentile("x", 30, 10, W.by_series()))
    assert column(a, "p") == column(b, "p")
    flat = df.filter("series_id = 'B'").withColumn("z", W.zscore("x", 10, 3, W.by_series()))
    assert set(column(flat, "z")) == {None}


def test_forward_drawdown_and_order_of_rows_does_not_matter(spark):
    v = np.random.default_rng(3).uniform(1, 9, 40)
    df = weekly(spark, v).orderBy(F.rand(7))
    got = column(df.withColumn("d", W.forward_drawdown("x", 4, W.by_series())), "d")
    for i in range(36):
        part = v[i : i + 5]
        assert got[i] == pytest.approx(min(part / np.maximum.accumulate(part) - 1))
    assert got[36:] == [None] * 4


def test_rank_decile_matches_quantile_cuts(spark):
    for n in (11, 37, 100):
        df = spark.range(1, n + 1).withColumn("b", C.rank_decile(F.col("id"), F.lit(n)))
        want = pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False) + 1
        assert [r.b for r in df.orderBy("id").collect()] == want.tolist()


def test_bucket_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.1000001,), (0.9,), (1.0,), (1.4,), (None,)], "x double")
    got = df.select(C.decile_closed_right("x").alias("a"), C.decile_floor("x").alias("b")).collect()
    assert [r.a for r in got] == [1, 1, 2, 9, 10, 10, None]
    assert [r.b for r in got] == [1, 2, 2, 10, 10, 10, None]


def test_asof_tolerance_same_day_and_future(spark):
    left = spark.createDataFrame([("A", D(2024, 1, 5), 1.0), ("A", D(2024, 1, 9), 2.0), ("B", D(2024, 1, 5), 3.0)], "series_id string, date date, v double")
    right = spark.createDataFrame([("A", D(2024, 1, 5), 10.0), ("B", D(2024, 1, 6), 30.0)], "series_id string, date date, close double")
    got = {(r.series_id, r.date): r.close for r in J.asof(left, right, ["close"], tolerance_days=4).collect()}
    assert got == {("A", D(2024, 1, 5)): 10.0, ("A", D(2024, 1, 9)): 10.0, ("B", D(2024, 1, 5)): None}
    with pytest.raises(ValueError, match="B 2024-01-05"):
        J.asof_strict(left, right, ["close"])
    same = {(r.series_id, r.date): r.close for r in J.asof_by_days(left, right, ["close"], 4).collect()}
    assert same == got


def test_correlations_native_and_vectorised_agree(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(a), float(b)) for k in "pq" for a, b in rng.integers(0, 6, (40, 2))] + [("flat", 1.0, float(i)) for i in range(10)] + [("few", 1.0, 2.0)]
    long = spark.createDataFrame(rows, "k string, x double, y double")
    a, b = ({r.k: (r.n, r.pearson, r.spearman) for r in f(long, ["k"]).collect()} for f in (S.correlations, S.correlations_by_series))
    for k in "pq":
        assert a[k] == pytest.approx(b[k])
    assert a["flat"][1:] == (None, None) and a["few"][1:] == (None, None)


def test_similar_states_ties_go_by_date_and_recent_rows_are_left_out(spark):
    rows = [("A", D(2018, 1, 2) + dt.timedelta(weeks=i), 0.5, 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "series_id string, date date, a double, b double")
    got = M.similar_states(df, ["a", "b"], top=4).orderBy("rank").collect()
    assert [r.date for r in got] == [r[1] for r in rows[:4]] and {r.score for r in got} == {100.0}
    assert M.similar_states(df, ["a", "b"], top=100).count() == 60 - 52


def test_paths_score_constant_and_vectorised(spark):
    df = weekly(spark, np.random.default_rng(8).uniform(size=90)).unionByName(weekly(spark, [0.4] * 90, "C"))
    a = M.similar_paths(df, "x", (4,)).select("series_id", "date", "rank", F.round("score", 6).alias("s"))
    b = M.similar_paths(df, "x", (4,), vectorised=True).select("series_id", "date", "rank", F.round("score", 6).alias("s"))
    assert sorted(a.collect()) == sorted(b.collect())
    assert {r.s for r in a.filter("series_id = 'C'").collect()} == {75.0}


def test_spaced_events_count_from_the_last_kept(spark):
    days = [0, 30, 55, 60, 110, 117, 300]
    df = spark.createDataFrame([("A", D(2020, 1, 1) + dt.timedelta(days=d)) for d in days], "series_id string, date date")
    kept = sorted((r.date - D(2020, 1, 1)).days for r in M.spaced_events(df).collect())
    assert kept == [0, 60, 117, 300]


def test_bar_reasons_and_merge_checks(spark):
    s = "series_id string, date date, open double, high double, low double, close double"
    old = spark.createDataFrame([("A", D(2024, 1, d), 1.0, 2.0, 0.5, 1.5) for d in (1, 2, 3)], s)
    new = spark.createDataFrame([("A", D(2024, 1, 3), 1.0, 0.4, 0.5, 1.5), ("A", D(2024, 1, 4), 2.0, 3.0, 1.0, 2.5), ("A", D(2024, 1, 4), 2.0, 3.0, 1.0, 2.5), ("A", D(2024, 1, 5), 1.0, 2.0, 0.5, 0.0)], s)
    assert [r.r for r in new.orderBy("date").select(K.bar_reason().alias("r")).collect()] == ["bounds_inconsistent", None, None, "bad_close"]
    got = K.merge_problems(old, new, ["series_id", "date"], F.lit("2024-01-02").cast("date"), F.lit("2024-01-05").cast("date"), F.lit("2020-01-01").cast("date")).first()
    assert (got.repeated, got.lost, got.invalid_recent, got.cold) == (1, 1, 1, 0)
    merged = K.merge_bars(old, new.dropDuplicates(), ["series_id", "date"])
    assert [r.close for r in merged.orderBy("date").collect()] == [1.5, 1.5, 1.5, 2.5]


def test_complete_bar_gate(spark):
    stamp = lambda x: dt.datetime.fromisoformat(x)
    df = spark.createDataFrame([("A", stamp("2024-07-09 04:00:00")), ("A", stamp("2024-07-10 04:00:00"))], "series_id string, ts timestamp")
    gate = lambda as_of: [r.ts.day for r in K.complete_bars(df, "ts", as_of, F.lit(None).cast("timestamp"), ["series_id"]).orderBy("ts").collect()]
    assert gate("2024-07-10 21:14:00") == [9]
    assert gate("2024-07-10 21:15:00") == [9, 10]


def _week(spark, hours=23, as_of="2024-07-20 00:00:00"):
    days = [D(2024, 7, 8) + dt.timedelta(days=i) for i in range(5)]
    daily = spark.createDataFrame([("A", d, 100.0 + i, 108.0 + i, 95.0 + i, 101.0 + i) for i, d in enumerate(days)], "series_id string, date date, open double, high double, low double, close double")
    rows = []
    for i, d in enumerate(days):
        first = dt.datetime(d.year, d.month, d.day) - dt.timedelta(hours=2)  # 18:00 in New York the day before
        for h in range(hours):
            t = first + dt.timedelta(hours=h)
            rows.append(("A", t, t + dt.timedelta(hours=1), d, 100.0, 108.0 + i if h == 12 else 101.0, 95.0 + i if h == 7 else 99.0, 100.0))
    hourly = spark.createDataFrame(rows, "series_id string, bar_start timestamp, bar_end timestamp, session_date date, open double, high double, low double, close double")
    off = spark.createDataFrame([], "date date")
    weeks = O.expectation(spark.createDataFrame([("A", D(2024, 7, 2))], "series_id string, report_date date"), off)
    return O.outcomes(weeks, daily, hourly, as_of)


def test_week_outcome_with_all_hours(spark):
    r = _week(spark).first()
    assert (r.coverage, r.week_state, r.hourly_coverage) == ("COMPLETE_DAILY", "ENDED", "COMPLETE_OBSERVED_HOURLY")
    assert (r.open, r.high, r.low, r.close) == (100.0, 112.0, 95.0, 105.0)
    assert r.high_date == D(2024, 7, 12) and r.low_date == D(2024, 7, 8) and r.order == "LOW_THEN_HIGH"
    assert r.high_reason == "MATCHED_FIRST_OBSERVED_HOUR_BUCKET" and r.low_start == dt.datetime(2024, 7, 8, 5)


def test_week_outcome_before_and_within_the_week(spark):
    r = _week(spark, as_of="2024-07-07 21:59:00").first()
    assert (r.coverage, r.week_state, r.open, len(r.days)) == ("PENDING", "PENDING", None, 0)
    r = _week(spark, as_of="2024-07-09 21:30:00").first()
    assert (r.coverage, r.week_state, len(r.days)) == ("PARTIAL", "IN_PROGRESS", 2)
    assert _week(spark, hours=22).first().hourly_coverage == "PARTIAL"


def test_availability_rules(spark):
    t = dt.datetime
    opens, closes = t(2024, 7, 7, 22), t(2024, 7, 12, 21)
    rows = [
        ("a", None, None, None, True, False), ("b", D(2024, 7, 8), None, None, True, False), ("c", D(2024, 7, 8), None, None, False, False), ("d", D(2024, 7, 5), D(2024, 7, 7), None, True, False),
        ("e", None, D(2024, 7, 5), None, True, False), ("f", None, D(2024, 7, 5), None, True, True), ("g", None, D(2024, 7, 9), t(2024, 7, 5, 19), True, False), ("h", D(2024, 7, 13), None, None, True, False),
    ]
    df = spark.createDataFrame(rows, "k string, scheduled date, actual_date date, actual_ts timestamp, has_source boolean, revision_risk boolean").withColumns({"opens": F.lit(opens), "closes": F.lit(closes)})
    got = {r.k: (r.status, r.eligible, r.relation) for r in O.availability(df).collect()}
    assert got["a"] == ("RELEASE_TIME_UNVERIFIED", None, "UNKNOWN")
    assert got["b"] == ("SCHEDULED_AFTER_WEEK_START", False, "DURING_OUTCOME_WEEK")
    assert got["c"][0] == "RELEASE_TIME_UNVERIFIED"
    assert got["d"][:2] == ("ACTUAL_PUBLICATION_DATE_OVERLAPS_WEEK_START", None)
    assert got["e"][:2] == ("ACTUAL_PUBLICATION_DATE_BEFORE_WEEK_START", True) and got["f"][1] is None
    assert got["g"][:2] == ("ACTUAL_RELEASE_BEFORE_WEEK_START", True) and got["h"][2] == "AFTER_OUTCOME_WEEK"


def test_readers_reject_and_resolve(spark, tmp_path):
    (tmp_path / "page.csv").write_text("<html><body>busy</body></html>\n")
    with pytest.raises(ValueError, match="web page"):
        R.read_headerless(spark, str(tmp_path / "page.csv"), ["a"])
    (tmp_path / "both.csv").write_text("GOLD,2024-01-02,1,2,3,4,5,6,7,Combined\n")
    head = ["Market_and_Exchange_Names", "Report_Date_as_YYYY-MM-DD", *[R.ALIASES[m][0] for m in R.MEASURES], "FutOnly_or_Combined"]
    with pytest.raises(ValueError, match="FutOnly"):
        R.read_headerless(spark, str(tmp_path / "both.csv"), head)
    (tmp_path / "closes.csv").write_text("series_id,Date,Close,Source\nA,2024-01-02,.,other feed\n")
    with pytest.raises(ValueError, match="vendor"):
        R.read_closes(spark, str(tmp_path / "closes.csv"), "vendor")
    with pytest.raises(ValueError, match="no column for oi"):
        R.resolve(["Market_and_Exchange_Names", "Report_Date_as_YYYY-MM-DD"])
    got = spark.createDataFrame([("950103",), ("2024-02-29",), ("02/29/2024",), ("x",), (None,)], "d string").select(C.mixed_date("d").alias("d")).collect()
    assert [r.d for r in got] == [D(1995, 1, 3), D(2024, 2, 29), D(2024, 2, 29), None, None]


def test_escape_and_scalar_sink(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", [1], 2), ("ok", [], 3)], "t string, a array<int>, n int")
    assert [r.t for r in sinks.escape_formulas(df).orderBy("n").collect()] == ["'=1+1", "ok"]
    sinks.write_outcomes(df, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/csv"), header=True).columns == ["t", "n"]


def test_chunks_give_the_windows_of_whole_series(spark):
    df = weekly(spark, np.random.default_rng(9).normal(size=50))
    parts = W.in_chunks(df, 16, 5)
    w = W.by_series(("series_id", "chunk"))
    a = parts.withColumn("m", F.sum("x").over(w.rowsBetween(-5, 0))).filter("not is_halo").select("series_id", "date", F.round("m", 9).alias("m"))
    b = df.withColumn("m", F.round(F.sum("x").over(W.by_series().rowsBetween(-5, 0)), 9)).select("series_id", "date", "m")
    assert sorted(a.collect()) == sorted(b.collect())


def test_bar_end_looks_at_every_stamp_in_one_pass(spark):
    rng = np.random.default_rng(2)
    base = dt.datetime(2024, 1, 2)
    stamps = {(f"s{i % 2}", base + dt.timedelta(seconds=int(x) * (60 if i % 3 else 1))) for i, x in enumerate(rng.integers(0, 30_000, 400))}
    end = dt.datetime(2024, 1, 20)
    df = spark.createDataFrame(sorted(stamps), "series_id string, ts timestamp")
    out = df.withColumn("bar_end", K.bar_end("ts", F.lit("2024-01-20 00:00:00").cast("timestamp"), ["series_id"]))
    for r in out.collect():
        later = [t for s, t in stamps if s == r.series_id and t > r.ts and t.second == 0]
        assert r.bar_end == min([r.ts + dt.timedelta(hours=1), end, *later])
    # a frame that ends without bound is read anew for each row
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


BAR = "series_id string, date date, open double, high double, low double, close double"


def test_merge_checked_rejects_a_batch_whole(spark):
    day = lambda k, close=10.0: ("A", D(2024, 1, k), 10.0, 11.0, 9.0, close)
    old = spark.createDataFrame([day(1), day(2), day(3)], BAR)
    args = (["series_id", "date"], F.lit(D(2024, 1, 2)), F.lit(D(2024, 1, 3)), F.lit(D(2024, 1, 1)))
    sound = spark.createDataFrame([day(2, 10.5), day(3), day(4)], BAR)
    assert column(K.merge_checked(old, sound, *args), "close") == [10.0, 10.5, 10.0, 10.0]
    for faulty, word in (([day(2), day(4)], "lost 1"), ([day(2), day(3), day(3)], "repeated 1"), ([day(2), day(3), day(4, 0.0)], "invalid_recent 1"), ([day(2), day(3), ("B", *day(4)[1:])], "cold 1")):
        batch = spark.createDataFrame(faulty, BAR)
        with pytest.raises(ValueError, match=word):
            K.merge_checked(old, batch, *args)
        assert K.merge_checked(old, batch, *args, rejected="keep").collect() == old.collect()


def test_stream_batches_are_rejected_whole_and_compacted(spark, tmp_path):
    day = lambda k, close=10.0: ("A", D(2024, 1, k), 10.0, 11.0, 9.0, close)
    root = str(tmp_path / "t")
    apply = B.upsert_into(root, whole=True)
    for number, rows in enumerate(([day(1), day(2)], [day(2, 10.5), day(3, 0.0)], [day(2, 10.6), day(4)])):
        apply(spark.createDataFrame(rows, BAR), number)
    assert sorted(r.reason for r in B.bar_table(spark, root).rejects().collect()) == ["bad_close", "batch_rejected"]
    assert column(B.current(spark, root), "close") == [10.0, 10.6, 10.0]
    B.compact(spark, root)
    B.upsert_into(root)(spark.createDataFrame([day(2, 99.0)], BAR), 2)  # a batch that ran before
    B.upsert_into(root)(spark.createDataFrame([day(4, 10.7)], BAR), 3)
    assert column(B.current(spark, root), "close") == [10.0, 10.6, 10.7]


def test_release_states(spark):
    def status(latest, observed="2024-01-09", fetched="2024-01-12 18:00:00", digest="a", now="2024-01-12 20:00:00"):
        parts = [(n, None if v is None else dt.date.fromisoformat(v)) for n, v in latest.items()]
        components = spark.createDataFrame(parts, "component string, latest date").withColumn("current", F.coalesce(F.col("latest") >= F.lit(D(2024, 1, 2)), F.lit(False)))
        sources = spark.createDataFrame([("reports", fetched, observed and dt.date.fromisoformat(observed), "a", digest)], "name string, fetched_at string, observed date, sha256 string, file_sha256 string")
        r = Q.release_status(components, sources, now, "reports", "hub").first()
        return r.status, r.stale, r.normal

    good = {"hub": "2024-01-09", "master": "2024-01-09"}
    # 15:00 on a Friday in New York is before the release, 16:00 after it
    assert status(good) == ("OK", [], D(2024, 1, 2))
    assert status(good, observed="2024-01-02", now="2024-01-12 21:00:00")[::2] == ("AWAITING_RELEASE", D(2024, 1, 9))
    assert status(good, observed="2024-01-09", now="2024-01-14 05:00:00")[::2] == ("OK", D(2024, 1, 9))
    assert status({"hub": "2024-01-09", "master": "2023-12-01"})[:2] == ("PARTIAL_STALE", [])  # the master is what others are held against
    assert status({**good, "paths": "2023-12-01"})[:2] == ("PARTIAL_STALE", ["paths"])
    assert status({"hub": "2023-12-01", "master": "2024-01-09"})[:2] == ("STALE", ["hub"])
    assert status({"hub": "2024-01-09", "master": None})[0] == "ERROR"
    none = spark.createDataFrame([("a", None, None, None, None), ("b", "2024-01-12 18:00:00", None, "x", None), ("c", "2024-01-09 18:00:00", None, "x", "y")], "name string, fetched_at string, observed date, sha256 string, file_sha256 string")
    assert [r[0] for r in Q.release_errors(none, "2024-01-12 20:00:00").orderBy("name").select(F.size("errors")).collect()] == [1, 1, 3]
    for bad in ({"digest": "b"}, {"fetched": None}, {"fetched": "2024-01-10 20:00:00"}, {"fetched": "2024-01-13 20:00:00"}, {"observed": None}):
        assert status(good, **bad)[0] == "SOURCE_UNVERIFIED"


def test_archived_hours_come_with_their_extremes(spark):
    schema = "series_id string, report_date date, closes timestamp, coverage string, hourly_coverage string, days array<struct<date: date>>, expected array<date>, missing array<date>, unexpected array<date>, open double, high double, low double, close double, high_start string"
    row = lambda coverage, hours, start, missing=(), expected=(), unexpected=(): ("A", D(2024, 1, 2), dt.datetime(2024, 1, 19), coverage, hours, [(D(2024, 1, 8),)], list(expected), list(missing), list(unexpected), 1.0, 2.0, 0.5, 1.5, start)
    frame = lambda r: spark.createDataFrame([r], schema)
    run = lambda a, b: O.archive_merge(frame(a), frame(b), "2024-01-13").first()
    done = run(row("COMPLETE_DAILY", "MISSING", None), row("COMPLETE_DAILY", "PARTIAL", "then"))
    assert (done.archive_status, done.hourly_coverage, done.high_start) == ("CURRENT_DAILY_WITH_ARCHIVED_HOURLY", "PARTIAL", "then")
    day = [D(2024, 1, 9)]
    same = run(row("PARTIAL", "MISSING", None, day), row("PARTIAL", "PARTIAL", "then", day))
    assert same.high_start == "then"
    for other in ({"missing": [D(2024, 1, 10)]}, {"missing": day, "expected": day}, {"missing": day, "unexpected": day}):
        got = run(row("PARTIAL", "MISSING", None, day), row("PARTIAL", "PARTIAL", "then", **other))
        assert (got.archive_status, got.high_start) == ("CURRENT_QUERY", None)
    for now, before in ((frame(row("PARTIAL", "MISSING", None)).drop("expected"), frame(row("PARTIAL", "MISSING", None))), (frame(row("PARTIAL", "MISSING", None)), frame(row("PARTIAL", "MISSING", None)).drop("unexpected"))):
        with pytest.raises(ValueError, match="outcomes lack"):
            O.archive_merge(now, before, "2024-01-13")
