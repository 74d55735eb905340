"""What the checks refuse, and admission and pacing against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from winnow.functions import text
from winnow.operators import evaluation, sampling
from winnow.sources import files, paging
from winnow.streaming import limiter


def test_paced_requests_start_as_a_loop_has_them(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), float(rng.randrange(0, 500)), i) for i in range(300)]
    free, want = {}, {}
    for host, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = max(t, free.get(host, t))
        free[host] = want[i] + 3.0
    df = spark.createDataFrame(rows, "host string, t double, event_id long")
    for span in (10.0, 1000.0):
        assert {r["event_id"]: r["start"] for r in limiter.paced(df, 3.0, span).collect()} == want
    assert limiter.paced(df.limit(0), 3.0).count() == 0


def test_late_requests_count_as_made_at_the_last_admitted_time():
    gate = limiter.Admission(minute=(2, 3), hour=(9, 9))
    assert [gate.allow(c, t) for c, t in (("a", 100.0), ("a", 50.0), ("a", 40.0), ("b", 110.0), ("b", 111.0), ("b", 161.0))] == [True, True, False, True, False, True]
    assert list(gate.admitted)[1] == ("a", 100.0)
    assert not limiter.Admission(minute=(0, 5)).allow("a", 1.0)


def test_pages_after_a_stop_and_scans_that_end_early(spark):
    rows = [("s", 1, 200, "*", "c1", 10, 15), ("s", 2, 200, "c1", "*", 5, 15), ("s", 3, 200, "*", "c3", 9, 15), ("t", 1, None, "*", None, None, None), ("u", 1, 200, "*", "n", 2, 1)]
    pages = spark.createDataFrame(rows, "scan string, page int, status int, cursor string, next_cursor string, items int, reported int")
    reached = paging.followed(pages)
    assert sorted((r["scan"], r["page"], r["stop"]) for r in reached.collect()) == [("s", 1, None), ("s", 2, "repeated_cursor"), ("t", 1, "unavailable"), ("u", 1, None)]
    report = paging.scan_report(reached)
    assert {r["scan"]: (r["pages"], r["retrieved"], bool(r["complete"]), r["error"]) for r in report.collect()} == {"s": (2, 15, False, "Pagination ended prematurely"), "t": (0, 0, False, "unavailable"), "u": (1, 2, False, "Pagination ended prematurely")}
    assert paging.whole_scans(report.where("scan = 's'")).count() == 1
    with pytest.raises(Exception, match="records and total differ in u"):
        paging.whole_scans(report.where("scan = 'u'")).collect()


def test_a_catalog_link_on_two_pages_is_an_error(spark):
    pages = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b"]), (1, 3, []), (2, 1, ["a"])], "group int, page int, links array<string>")
    assert [(r["page"], r["complete"]) for r in paging.catalog_scan(pages.where("group = 2")).collect()] == [(1, False)]
    with pytest.raises(Exception, match="a link on two pages: b"):
        paging.catalog_scan(pages).collect()


def test_a_split_short_of_rows_is_refused(spark):
    there = spark.createDataFrame([("a", 5), ("b", 2)], "s string, available long")
    needed = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1)], "s string, needed long")
    sampling.require_enough(there, needed.where("s = 'a'"), "s")
    with pytest.raises(ValueError, match="'s': 'b', 'missing': 1.*'s': 'c', 'missing': 1"):
        sampling.require_enough(there, needed, "s")


def test_a_screen_that_is_not_whole_has_no_best_rate(spark):
    trials = spark.createDataFrame([(0.2, 0.5, 2, True, "screen"), (0.1, 0.5, 1, True, "screen")], "learning_rate double, top3 double, epoch int, checks_pass boolean, mode string")
    assert evaluation.best_rate(trials, [0.1, 0.2]).first()["learning_rate"] == 0.1
    for bad in (trials.where("learning_rate = 0.1"), trials.withColumn("mode", F.lit("pilot")), trials.withColumn("checks_pass", F.col("learning_rate") < 0.15)):
        with pytest.raises(ValueError, match="screen trial"):
            evaluation.best_rate(bad, [0.1, 0.2])


def test_measurements_that_are_no_numbers_are_refused(spark):
    rows = [("r", 1, 1.0, 0.5), ("r", 2, 1.0, 0.5), ("r", 3, float("nan"), 0.5), ("r", 4, 2.0, float("nan")), ("r", 5, 3.0, None), ("r", 6, float("inf"), 0.1), ("s", 1, 0.0, 0.1), ("s", 2, 0.5, 1.0)]
    h = spark.createDataFrame(rows, "run string, place int, epoch double, score double")
    assert sorted(map(tuple, evaluation.refused_checks(h, "run", "place", "epoch", "score").collect())) == [("r", 2), ("r", 3), ("r", 4), ("r", 5), ("r", 6), ("s", 1)]


def test_manifests_and_copies(spark, tmp_path):
    a = spark.createDataFrame([("x", 1, "h"), ("y", 2, "g")], "name string, bytes long, sha256 string")
    digest = lambda df: files.manifest_digest(df).first()[0]
    assert digest(a) == digest(a.orderBy(F.desc("name"))) != digest(a.where("name = 'x'"))
    files.write_jsonl(a, f"{tmp_path}/from")
    files.copy_folder(spark, f"{tmp_path}/from", f"{tmp_path}/to")
    assert sorted(files.read_jsonl(spark, f"{tmp_path}/to", "name string, bytes long, sha256 string").collect()) == sorted(a.collect())
    with pytest.raises(FileExistsError):
        files.copy_folder(spark, f"{tmp_path}/from", f"{tmp_path}/to")


def test_ends_of_texts(spark):
    cases = {"a text. 11A05, 11B25 ": "a text.", " ends 12": "ends 12", "no codes": "no codes", "14H10\n": "", "": "", "x 11A05 y": "x 11A05 y"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", text.drop_dangling_codes(F.col("x")).alias("y")).collect()} == cases
    words = spark.createDataFrame([(" " * 3 + "w " * n, n) for n in range(5)], "x string, n int")
    assert all(r["y"] == (r["n"] >= 3) for r in words.select("n", text.has_words(F.col("x"), 3).alias("y")).collect())


def test_disagreement_of_runs_joins_no_scores(spark, tmp_path):
    rng = random.Random(3)
    runs = [[(q, i, rng.randint(0, 9) / 9) for q in range(40) for i in range(8) if rng.random() < 0.8] for _ in range(2)]
    runs[1] = [r if r[0] % 2 else (r[0], r[1], p) for r in runs[1] for p in [dict(((a, b), c) for a, b, c in runs[0]).get(r[:2], r[2])]]  # every second query agrees
    runs[0] += [(7, 1, 0.5), (7, 1, 0.9), (None, 1, 0.1), (50, 1, 0.2)]  # an item listed again, a row of no query, a query of one run
    for n, x in zip("ab", runs, strict=True):
        spark.createDataFrame(x, "paper_id long, journal_id long, p double").write.parquet(f"{tmp_path}/{n}")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")  # files, whose size Spark goes by
    found = evaluation.disagreement(a, b)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # of 19 million scores it took the driver's memory
    places = [{}, {}]
    for place, rows in zip(places, runs, strict=True):
        for q in {r[0] for r in rows} - {None}:
            for k, (_, i, p) in enumerate(sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))):
                place.setdefault((q, i), []).append((p, k))
    pairs = [(q, x, y) for (q, i), xs in places[0].items() for x in xs for y in places[1].get((q, i), [])]
    differ = lambda k: len({q for q, x, y in pairs if (x[1] < k) != (y[1] < k)})
    assert tuple(found.first()) == (max(abs(x[0] - y[0]) for _, x, y in pairs), differ(1), differ(3))
    assert 0 < differ(1) < differ(3) < 40
