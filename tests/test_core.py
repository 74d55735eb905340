"""Operators on small tables, with the cases that decide between rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from winnow.functions import numeric, records, text
from winnow.operators import counts, dedup, evaluation, joins, retrieval, rules, sampling
from winnow.operators.components import connected_components
from winnow.sources import files, web
from winnow.streaming import limiter


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "raw, want",
    [
        (None, ""),
        ("<jats:title>Abstract</jats:title><jats:p>We  show&amp;prove.</jats:p><p>More</p>", "We show&prove. More"),
        ("Abstract: A text. Published in Some Journal. It goes on.", "A text. It goes on."),
        ("Body © 2020 Somebody", "Body"),
        ("a<br>b", "a b"),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, text.clean_text) == want


def test_markup_of_any_shape(spark):
    cases = {"a<!-- <p> -->b": "ab", "x <a title='1>2'>y</a> z": "x y z", "<jats:P>one</jats:P><br/>two": "one two", "3 < 4 &amp;amp; 5": "3 < 4 & 5", "end <p unclosed": "end", "no\u00a0marks\x1chere": "no marks here"}
    assert {k: one(spark, k, text.clean_text) for k in cases} == cases


def test_plain_math_keeps_comparisons(spark):
    assert one(spark, "for 1<p<2 and <i>x</i> &lt; y <p<1", text.plain_math_text) == "for 1<p<2 and x < y <p<1"


def test_last_cut_needs_a_sentence_before_it(spark):
    assert one(spark, "A result. 1. introduction and more", text.cut_abstract) == "A result." and one(spark, "A 1. introduction", text.cut_abstract) == "A 1. introduction"


def test_a_missing_anchor_is_an_error(spark):
    df = spark.createDataFrame([("a", "T", "words", "j")], "paper_id string, title string, abstract string, journal_id string")
    with pytest.raises(Exception, match="the text to start from is missing: a"):
        rules.clean_papers(df, keep_from={"a": "START"})[1].collect()


@pytest.mark.parametrize("raw, want", [("Straße  &amp; x+y..", "strasse & x+y"), ("ﬁne\tTitle", "fine title"), ("", "")])
def test_title_key(spark, raw, want):
    assert one(spark, raw, text.title_key) == want


@pytest.mark.parametrize("raw, want", [("The Journál & Co", "journalandco"), ("Theory", "theory")])
def test_name_key(spark, raw, want):
    assert one(spark, raw, text.name_key) == want


def test_identifier_functions(spark):
    assert one(spark, " https://DOI.org/10.1/Ab ", text.doi_key) == "10.1/ab" and one(spark, None, text.doi_key) == ""
    assert one(spark, "https://arxiv.org/pdf/2101.00001v3.pdf", text.arxiv_key) == "2101.00001"
    assert [one(spark, v, text.valid_issn) for v in ("0378-5955", "0378-5954", "2434-561X", "x", None)] == [True, False, True, False, False]
    assert one(spark, "https://arxiv.org/abs/2610.08776v2", text.arxiv_id) == "2610.08776v2"
    assert [one(spark, v, text.arxiv_id) for v in ("2613.00001", "http://arxiv.org/abs/2610.08776", "2610.08776\n2", "é2610.08776")] == [None] * 4
    assert [one(spark, v, text.client_key) for v in ("10.0.0.1", "::ffff:10.0.0.1", "2001:db8::5", "no")] == ["10.0.0.1", "10.0.0.1", "2001:db8::/64", None]


@pytest.mark.parametrize("title, bad", [("Erratum to: X", True), ("Publisher Correction: X", True), ("Front matter", True), ("Corrigenda", True), ("Some errata to a paper", True), ("Obituary of X", True), ("Corrections of order two", False), ("Error terms", False), ("A preface problem", False)])
def test_unsuitable_titles(spark, title, bad):
    assert one(spark, title, text.unsuitable_title) == bad


def test_publication_year_and_inverted_index(spark):
    p = lambda y: f"array(array({y}))" if y else "cast(array() as array<array<int>>)"
    row = lambda *ys: spark.range(1).select(records.publication_year(*[F.expr(p(y)) for y in ys]).alias("r")).first()["r"]
    assert tuple(row(2019, 2020, None, None)) == (2019, "published-print") and tuple(row(None, None, None, 2001)) == (2001, "issued") and row(None, None, None, None) is None
    index = lambda e: spark.range(1).select(records.from_inverted_index(F.expr(e)).alias("r")).first()["r"]
    assert index("map('b', array(1), 'a', array(0, 2))") == "a b a"
    assert index("map('a', array(0, 0))") is None and index("map('a', array(1))") is None and index("cast(null as map<string,array<int>>)") == ""


def test_softmax_and_probabilities(spark):
    r = spark.range(1).select(numeric.softmax(F.expr("array(1D, 2D, 3D)")).alias("p"), numeric.log_softmax(F.expr("array(1000D, 1000D)")).alias("l")).select("p", "l", numeric.valid_probabilities(F.col("p"), 3).alias("ok"), numeric.valid_probabilities(F.expr("array(0.5D, double('nan'))"), 2).alias("nan")).first()
    assert abs(sum(r["p"]) - 1) < 1e-12 and abs(r["l"][0] + 0.6931471805599453) < 1e-9 and r["ok"] and not r["nan"]


def test_later_rules_override_and_cleanup_logs(spark):
    words = " ".join(f"w{i}" for i in range(20))
    rows = [("a", "T", words + " Keywords: x", "j"), ("b", "Paper Award", "This special issue", "j"), ("c", "T", "short", "j"), ("d", "T", words, "j"), ("e", "T", "junk START " + words + " STOP tail", "j")]
    good, log = rules.clean_papers(spark.createDataFrame(rows, "paper_id string, title string, abstract string, journal_id string"), keep_from={"e": "START"}, cut_before={"e": "STOP"})
    assert {r["paper_id"]: r["abstract"] for r in good.collect()} == {"a": words, "d": words, "e": "START " + words}
    assert {r["paper_id"]: r["reason"] for r in log.collect()} == {"a": None, "b": "special-issue introduction", "c": "insufficient text after conservative cleanup", "e": None}


@pytest.mark.parametrize("one_task", [0, 1 << 18])
def test_components_agree_with_union_find(spark, one_task):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (900, 900), (None, 3), (901, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    root(3)  # an edge with one end names that end
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {x: root(x) for x in list(parent)} | {901: 901}


def test_dedup_merges_carries_keys_and_sets_conflicts_apart(spark):
    schema = "paper_id string, title string, abstract string, journal_id string, doi string"
    rows = [("1", "Same Title", "long abstract", "j", ""), ("2", "same title.", "short", "j", "10.1/x"), ("3", "Other", "a", "j", "10.1/X"), ("4", "Introduction", "a", "j", ""), ("5", "Introduction", "b", "j", ""), ("6", "Clash", "a", "j", ""), ("7", "clash", "b", "k", "")]
    good, bad = dedup.deduplicate(spark.createDataFrame(rows, schema))
    found = {r["paper_id"]: r for r in good.collect()}
    assert sorted(found) == ["1", "4", "5"] and found["1"]["versions"] == ["1", "2", "3"] and len(found["1"]["group_id"]) == 24
    assert sorted(r["paper_id"] for r in bad.collect()) == ["6", "7"]
    assert {r[0]: r[1] for r in dedup.conflicts_by_journal(bad).collect()} == {"j": 1, "k": 1}
    again, _ = dedup.deduplicate(good.drop("group_id"))
    assert {r["paper_id"]: (r["group_id"], r["versions"]) for r in again.collect()} == {k: (v["group_id"], v["versions"]) for k, v in found.items()}
    import hashlib

    keys = [["doi", "10.1/x"], ["title", "other"], ["title", "same title"]]
    assert found["1"]["group_id"] == hashlib.sha256(json.dumps(keys).encode()).hexdigest()[:24]


def test_unknown_is_not_zero(spark):
    df = spark.createDataFrame([("a", "complete", None), ("b", "incomplete", 5), ("c", "complete", 3)], "k string, s string, n long")
    assert [r[0] for r in df.orderBy("k").select(counts.known_count(F.col("s"), F.col("n"))).collect()] == [0, None, 3]


def test_variants(spark):
    rows = [("a", "v1", "s", None, 1), ("a", "v1", "s", None, 2), ("b", "v1", "s", None, 3), ("b", "v2", "t", None, 4), ("c", "v1", None, "bad", 5), ("c", "v2", "s", None, 6), ("d", "v1", None, "r1", 7), ("d", "v2", None, "r0", 8)]
    df = spark.createDataFrame(rows, "k string, v string, s string, r string, o long")
    got = {r["k"]: (r["outcome"], r["first_good"]) for r in counts.resolve_variants(df, "k", F.col("v"), F.col("s"), F.col("r"), F.col("o")).collect()}
    clash = ("conflicting_metadata_versions", None)
    assert got == {"a": ("accepted", 1), "b": clash, "c": clash, "d": ("r1", None)}


def test_quotas(spark):
    quotas = lambda total, rows: dict(sampling.quotas(spark.createDataFrame(rows, "k string, w double, c long"), "k", "w", "c", total).collect())
    assert quotas(10, [("a", 5.0, 2), ("b", 3.0, 10), ("c", 2.0, 10)]) == {"a": 2, "b": 5, "c": 3}
    assert quotas(7, [("a", None, 10), ("b", None, 10)]) == {"a": 4, "b": 3}
    assert sum(quotas(100, [("a", 1.0, 5), ("b", None, 6)]).values()) == 11 and quotas(5, []) == {}


@pytest.mark.parametrize("total, minimum, weights", [(1, 1, [1, 2]), (10, -1, [1, 2]), (10, 1, [1, -2])])
def test_floor_quotas_refuses(spark, total, minimum, weights):
    with pytest.raises(ValueError):
        sampling.floor_quotas(spark.createDataFrame(list(enumerate(weights)), "k long, w long"), "k", "w", total, minimum)


def test_floor_quotas(spark):
    df = spark.createDataFrame([("large", 999), ("small", 1)], "k string, w long")
    assert dict(sampling.floor_quotas(df, "k", "w", 10).collect()) == {"large": 9, "small": 1}


def test_split_is_disjoint_and_ignores_input_order(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}") for i in range(60)], "id long, s string")
    parts = lambda d: {r["id"]: r["part"] for r in sampling.split_parts(d, "s", "id", [("validation", 2), ("test", 4)]).collect()}
    a = parts(df)
    assert a == parts(df.orderBy(F.desc("id")))
    assert sorted(a.values()).count("validation") == 6 and sorted(a.values()).count("test") == 12


def test_leaks_are_found(spark):
    rows = [("train", ["a"], "h1"), ("validation", ["b"], "h2"), ("test", ["c"], "h1"), ("screen", ["a"], "h9")]
    df = spark.createDataFrame(rows, "part string, ids array<string>, text_hash string")
    assert [tuple(r)[:2] for r in sampling.overlaps(df, ["ids", "text_hash"]).collect()] == [("text_hash", "h1")]


def test_joins_with_conditions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, k string")
    b = spark.createDataFrame([("x", 10), ("y", 20), ("y", 30)], "k string, v long")
    assert [tuple(r) for r in joins.unique_match(a, b, ["k"], "id").collect()] == [("x", 1, 10)]
    with pytest.raises(ValueError, match="gone"):
        joins.require_empty(joins.missing(a, b, ["k"]), "gone")
    assert [r[0] for r in joins.differing_keys(a, a.where("id < 3").withColumn("k", F.expr("if(id = 2, 'q', k)")), "id", ["k"]).orderBy("id").collect()] == [2, 3]
    assert [r[0] for r in joins.without_shared_keys(a.withColumn("keys", F.array("k")), "keys", spark.createDataFrame([("x",)], "key string"), "id").orderBy("id").collect()] == [2, 3]


def test_metrics_with_a_target_that_is_no_candidate(spark):
    scores = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.5), ("q", "a", 0.1)], "paper_id string, journal_id string, p double")
    ranks = evaluation.target_ranks(scores, spark.createDataFrame([("p", "b"), ("q", "z")], "paper_id string, target string"))
    m = evaluation.metrics(ranks).first()
    assert (m["n"], m["candidate_recall"], m["top1"], m["top3"], m["mrr"], m["conditional_top1"], m["macro_top3"]) == (2, 0.5, 0, 0.5, 0.25, 0, 0.5)


def test_bootstrap_draws_from_the_counts(spark):
    deltas = [0, 1, -1, 1, 0, 1] * 50
    df = spark.createDataFrame(list(enumerate(deltas)), "paper_id long, delta int")
    got = evaluation.bootstrap(df).first()
    rng = random.Random(1)
    draws = sorted(sum(rng.choices(deltas, k=300)) / 300 for _ in range(2000))
    assert got == evaluation.bootstrap(df.repartition(7)).first() and got["samples"] == 2000 and got["top3_delta"] == pytest.approx(1 / 3)
    assert abs(got["low"] - draws[50]) < 0.02 and abs(got["high"] - draws[1950]) < 0.02
    assert evaluation.bootstrap(df.limit(0)).count() == 0


def test_stopping_after_three_bad_checks(spark):
    h = spark.createDataFrame([("r", float(i + 1), v) for i, v in enumerate([0.5, 0.6, 0.6, 0.5, 0.55])], "run string, e double, s double")
    assert [(r["bad_checks"], r["stop"]) for r in evaluation.stopping(h, "run", "e", "s").orderBy("e").collect()] == [(0, False), (0, False), (1, False), (2, False), (3, True)]
    assert tuple(evaluation.best_checkpoint(h, "run", "e", "s").first()) == ("r", 2.0, 0.6)


def test_shortlist_inserts_a_missing_target(spark):
    scored = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.1)], "query_id long, grp string, score double")
    got = retrieval.shortlist(scored, 2, spark.createDataFrame([(1, "c")], "query_id long, target string")).orderBy("place").collect()
    assert [(r["grp"], r["inserted"]) for r in got] == [("a", False), ("c", True)]


def plain_admission(rows, minute, hour):
    admitted, out = [], []
    for client, t in rows:
        own = [x for c, x in admitted if c == client]
        every = [x for _, x in admitted]
        ok = all(sum(x > t - 60 for x in xs) < m and sum(x > t - 3600 for x in xs) < h for xs, m, h in ((own, minute[0], hour[0]), (every, minute[1], hour[1])))
        admitted += [(client, t)] * ok
        out.append(ok)
    return out


def test_admission_in_a_batch(spark):
    rng = random.Random(3)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0, 0.5, 5, 60, 400])
        rows.append(("gate", rng.choice("abc"), t, i))
    want = plain_admission([(c, t) for _, c, t, _ in rows], (6, 12), (40, 300))
    df = spark.createDataFrame(rows, "limiter string, client string, t double, event_id long")
    assert [r["allowed"] for r in limiter.admit(df).orderBy("event_id").collect()] == want


def test_files_and_saved_responses(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "q"', None), ("b", "", 2)], "id string, s string, n long")
    files.write_jsonl(df, f"{tmp_path}/j")
    files.write_csv(df.select("id", "s"), f"{tmp_path}/c")
    assert sorted(files.read_jsonl(spark, f"{tmp_path}/j", "id string, s string, n long").collect()) == sorted(df.collect())
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/c", ["id", "s"]).collect())) == [("a", 'x "q"'), ("b", "")]
    with pytest.raises(Exception, match="already exists"):
        files.write_jsonl(df, f"{tmp_path}/j")
    (tmp_path / "cat.csv").write_text("journal_id,journal_name,issns\nj,J,1234-5678;2345-6789\nk,K,\n")
    assert [r["issns"] for r in files.read_catalog(spark, str(tmp_path / "cat.csv")).orderBy("journal_id").collect()] == [["1234-5678", "2345-6789"], []]
    (tmp_path / "feed.xml").write_text("<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>1</id><title>T</title><summary>S</summary><category term='math.AG' scheme='s'/></entry><entry><id>2</id><title>U</title></entry></feed>")
    assert [(r["id"], r["title"]) for r in files.read_atom(spark, str(tmp_path / "feed.xml")).orderBy("id").collect()] == [("1", "T"), ("2", "U")]
    (tmp_path / "bad.xml").write_text("<!DOCTYPE x><feed/>")
    with pytest.raises(Exception, match="refused"):
        files.read_atom(spark, str(tmp_path / "bad.xml")).collect()
    found = files.file_hashes(spark, f"{tmp_path}/cat.csv")
    assert files.differing_files(found, found).count() == 0 and files.differing_files(found, found.withColumn("bytes", F.lit(1).cast("long"))).count() == 1
    body = json.dumps({"message": {"items": [{"DOI": "d1"}, {"DOI": "d2"}], "total-results": 3}})
    cache = spark.createDataFrame([("http://x/1", 200, body)], "url string, status int, body string").withColumn("key", web.cache_key(F.col("url")))
    asked = spark.createDataFrame([("http://x/1", "g", 0)], "url string, group string, page int")
    pages = web.fetch_saved(asked, cache)
    assert [r["item"]["DOI"] for r in web.pages_of_items(pages, "struct<DOI:string>").orderBy("place").collect()] == ["d1", "d2"]
    assert tuple(web.scan_completeness(pages).first()) == ("g", 2, 3, False)
    with pytest.raises(Exception, match="not saved"):
        web.fetch_saved(asked.withColumn("url", F.lit("http://x/2")), cache).collect()
