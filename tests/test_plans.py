"""Publisher pages, series and experiment checks."""

import json

import pytest
from pyspark.sql import functions as F

from winnow.operators import series
from winnow.plans import experiment
from winnow.sources import publishers


def test_archive_titles(spark):
    body = '<a href="/j/2020/26-1.html">x</a><td class="a style60">A <b>Title</b></td><hr size=1><td class="style60">Erratum</td><a href="/j/2020/26-2.html">y</a><hr>foot'
    pages = spark.createDataFrame([(2020, body)], "year int, body string")
    rows = publishers.archive_titles(pages, "https://x").orderBy("url").collect()
    assert [tuple(r) for r in rows] == [(2020, "https://x/j/2020/26-1.html", "A Title", False), (2020, "https://x/j/2020/26-2.html", "Erratum", True)]
    for bad in ("nothing", body.replace("<hr size=1>", "")):
        with pytest.raises(Exception, match="archive of"):
            publishers.archive_titles(spark.createDataFrame([(2020, bad)], "year int, body string"), "https://x").collect()


def test_catalog_cards(spark):
    card = '<a class="publication x" href="/p/1&amp;a"><div class="publication__more_info">Article - Tome 400 - pp 1-9 - 2018</div><h3 class="publication__title">T</h3><div class="publication__text">A. B</div><div class="publication__collection">Astérisque</div></a>'
    row = publishers.catalog_cards(spark.createDataFrame([(2018, f"..{card}..")], "year int, body string"), "https://s", "Astérisque").first()
    assert tuple(row) == ("T", "A. B", 2018, "Article", "400", "1-9", "https://s/p/1&a")
    with pytest.raises(Exception, match="unexpected card"):
        publishers.catalog_cards(spark.createDataFrame([(2019, card)], "year int, body string"), "https://s", "Astérisque").collect()


def test_product_index(spark):
    entry = lambda v, n, i: {"ProductCode": f"MEMO/{v}/{n}", "CopyrightYear": "2018", "IssueNumber": i}
    page = lambda *e: spark.createDataFrame([("<script>var productDetailObj = " + json.dumps({"SeriesVolumes": list(e)}) + "; more()</script>",)], "body string")
    rows = publishers.product_index(page(entry(230, 1100, 1100), entry(230, 1101, 7)), "u=").orderBy("number").collect()
    assert [(r["number"], r["volume"], r["publisher_number_conflict"], r["url"]) for r in rows] == [(1100, 230, False, "u=MEMO/230/1100"), (1101, 230, True, "u=MEMO/230/1101")]
    with pytest.raises(Exception, match="repeated number"):
        publishers.product_index(page(entry(1, 5, 5), entry(2, 5, 5)), "u=").collect()


def test_import_page(spark):
    meta = lambda n, v: f'<meta name="{n}" content="{v}"/>'
    html = meta("citation_title", "A  T") + meta("citation_abstract", "Abs") + meta("citation_arxiv_id", "2101.00001") + '<meta property="og:url" content="https://arxiv.org/abs/2101.00001v2"/><td class="tablecell subjects">Algebra (math.AG); X (cs.IT)</td>'
    page = lambda asked, body: spark.createDataFrame([(asked, body)], "requested string, body string")
    row = publishers.import_page(page("2101.00001", html)).first()
    assert tuple(row)[1:] == ("2101.00001v2", "A T", "Abs", "", ["math.AG", "cs.IT"])
    assert publishers.import_page(page("2101.00001v2", html)).select(publishers.in_scope(F.col("categories"), ["math-ph"])).first()[0]
    for asked, body in (("2101.00002", html), ("2101.00001v1", html), ("2101.00001", html + meta("citation_title", "B")), ("2101.00001", html.replace("subjects", "x"))):
        with pytest.raises(Exception, match="page is not of|ambiguous"):
            publishers.import_page(page(asked, body)).collect()


def test_bounded_pages(spark):
    df = lambda b: spark.createDataFrame([(bytearray(b),)], "content binary")
    assert publishers.bounded(df("﻿é".encode())).first()["body"] == "é"
    for bad in (b"\xff\xfe", b"a\0b", b"x" * 2_000_000):
        with pytest.raises(Exception, match="refused"):
            publishers.bounded(df(bad)).collect()


CARDS = "volume string, kind string, title string, year int, url string"
BOOKS = "volume string, title string, year int, url string, dois array<string>, contents array<struct<url:string,title:string>>"


def test_volumes_are_replaced_by_their_parts(spark):
    cards = spark.createDataFrame([("1", "Livre", "Book", 2018, "b1"), ("1", "Article", "Part", 2018, "a1"), ("2", "Livre", "Alone", 2019, "b2"), ("3", "Livre", "Old", 2019, "b3")], CARDS)
    books = spark.createDataFrame([("1", "Book", 2018, "b1", [], [("a1", "Part"), ("a2", "Found"), ("a3", "Preface")]), ("2", "Alone", 2019, "b2", ["10.1/bad", "10.1/x"], []), ("3", "Old", 2019, "b3", [], [])], BOOKS)
    reprints = spark.createDataFrame([("3", "r")], "volume string, review string")
    ignored = spark.createDataFrame([("2", "10.1/bad")], "volume string, doi string")
    works, rejected, recovered = series.reconcile_volumes(cards, books, reprints, ignored)
    assert sorted(r["paper_id"] for r in works.collect()) == ["a1", "a2", "doi:10.1/x"]
    assert sorted((r["volume"], r["reason"]) for r in rejected.collect()) == [("1", "enclosing_collection"), ("1", "unsuitable_title"), ("3", "reprint")]
    assert sorted(r["url"] for r in recovered.collect()) == ["a2", "a3"]
    with pytest.raises(Exception, match="disagree"):
        series.reconcile_volumes(cards.unionByName(spark.createDataFrame([("1", "Article", "Q", 2018, "zz")], CARDS)), books, reprints, ignored)[0].collect()


def test_numbered_works(spark):
    records = spark.createDataFrame([(10, 5, "d10", "T", 2018), (11, 5, "d11", "T", None), (12, 5, "d12", "Preface", 2018), (13, 5, "d13", "T", None), (14, 5, "d14", "T", None), (20, 6, "d20", "T", None)], "number int, volume int, doi string, title string, cited_year int")
    overrides = spark.createDataFrame([(13, "d13", 2019, "review", False), (14, "d14", 2019, "review", True)], "number int, doi string, year int, source_kind string, exclude boolean")
    rows = series.numbered_works(records, overrides, 10, 14, 5, 5).orderBy("number").collect()
    assert [(r["status"], r["year"]) for r in rows] == [("confirmed", 2018), ("unresolved", None), ("excluded_unsuitable_title", 2018), ("confirmed", 2019), ("excluded_after_review", None), ("outside_volume_window", None)]
    assert [r[0] for r in series.missing_numbers(records, 10, 16).orderBy("number").collect()] == [15, 16]
    with pytest.raises(Exception, match="DOI differs"):
        series.numbered_works(records, overrides.withColumn("doi", F.lit("z")), 10, 14, 5, 5).collect()


def test_citation_checks(spark):
    works = spark.createDataFrame([(1201, "On the Moduli of Curves", "Müller")], "number int, title string, first_author string")
    source = "Mem. Am. Math. Soc. 1201"
    rows = [("On the moduli of curves", "Muller, A.; B", source, "2018"), ("Something else entirely", "Müller, A.", source, "2018"), ("On the moduli of curves", "Other, A.", source, "2018"), ("On the moduli of curves", "Müller, A.", "Mem. Am. Math. Soc. 11201", "2018")]
    matches = spark.createDataFrame([(1201, *r) for r in rows], "number int, match_title string, match_authors string, source string, year string")
    named = F.col("source").rlike(r"Mem\.\s*Am\.\s*Math\.\s*Soc\.")
    got = series.citation_checks(works, matches, named).collect()
    assert sorted((r["author_match"], r["number_match"], r["accepted"]) for r in got) == sorted([(True, True, True), (True, True, False), (False, True, False), (True, False, False)])
    assert [r["only"] for r in got if r["accepted"]] == [True]


CANDIDATES = [("a", "Alpha"), ("b", "Beta")]


def test_requests_and_their_violations(spark):
    catalog = spark.createDataFrame([("b", "Beta"), ("a", "Alpha")], "journal_id string, journal_name string")
    assert experiment.ordered_candidates(catalog, 2) == CANDIDATES
    with pytest.raises(ValueError):
        experiment.ordered_candidates(catalog, 3)
    papers = spark.createDataFrame([("p", "g", 'A "quoted" title', "one two three four", "b"), ("q", "h", "T", "text", "a")], "paper_id string, group_id string, title string, abstract string, target string")
    rows = experiment.requests(papers, CANDIDATES, "Which?", True, lambda c: experiment.first_words(c, 4)).cache()
    body = json.loads(rows.where("paper_id = 'p'").first()["request"])
    assert body["state"] == 'Manuscript:\nA "quoted" title one' and list(body["questions"]["journal"]["criteria"].items()) == [("Alpha", None), ("Beta", None)] and body["questions"]["journal"]["label"] == "Beta"
    assert experiment.request_violations(rows, CANDIDATES, True).count() == 0
    said = lambda df, training=True: {r["violation"] for r in experiment.request_violations(df, CANDIDATES, training).collect()}
    assert said(rows, False) == {"label outside training"}
    assert said(rows.withColumn("request", F.replace("request", F.lit('"Alpha":null,"Beta":null'), F.lit('"Beta":null,"Alpha":null')))) == {"candidates differ"}
    assert said(rows.withColumn("target", F.lit("z"))) == {"target is no candidate"}
    assert said(rows.withColumn("request_hash", F.lit("0"))) == {"hash differs"}
    assert said(rows.withColumn("target", F.lit("a"))) == {"label differs"}
    assert said(rows.withColumn("group_id", F.lit("g"))) == {"repeated paper or group"}


def test_predictions_selection_and_stages(spark):
    schema = "paper_id string, target string, candidates array<string>, probabilities array<double>, ranking array<string>"
    good = spark.createDataFrame([("p", "b", ["a", "b"], [0.4, 0.6], ["b", "a"]), ("q", "a", ["a", "b"], [0.5, 0.5], ["a", "b"])], schema)
    expected = good.select("paper_id", "target")
    assert experiment.prediction_violations(good, expected, ["a", "b"]).count() == 0
    assert experiment.metrics_of(good).first()["top1"] == 1.0
    bad = good.withColumn("ranking", F.expr("array('a', 'b')")).withColumn("probabilities", F.expr("if(paper_id = 'q', array(0.5D, 0.6D), probabilities)"))
    assert {tuple(r) for r in experiment.prediction_violations(bad, expected, ["a", "b"]).collect()} == {("p", "ranking differs"), ("q", "probabilities are invalid")}
    papers = spark.createDataFrame([("p", "T", 2)], "paper_id string, title string, year int")
    hashed = papers.select("paper_id", F.sha2(F.to_json(F.struct("paper_id", "title", "year")), 256).alias("record_sha256"), F.lit("test").alias("part"))
    row = experiment.without_text(experiment.frozen_selection(hashed, papers)).first()
    assert row["year"] == 2 and row["title"] is None
    with pytest.raises(Exception, match="missing or changed"):
        experiment.frozen_selection(hashed, papers.withColumn("year", F.lit(3))).collect()
    log = lambda *rows: spark.createDataFrame(list(rows), "mode string, learning_rate double, status string, checks_pass boolean, prepared_hash string, top3 double, epoch double")
    pilot, one, two = ("pilot", 0.1, "complete", True, "h", 0.5, 1.0), ("screen", 0.1, "complete", True, "h", 0.5, 1.0), ("screen", 0.2, "complete", True, "h", 0.5, 1.0)
    assert experiment.open_stages(log(("pilot", 0.1, "complete", False, "h", 0.5, 1.0)), "h", [0.1, 0.2]) == [("pilot", None)]
    assert experiment.open_stages(log(pilot, one), "h", [0.1, 0.2]) == [("screen", 0.2)]
    assert experiment.open_stages(log(pilot, one, two), "h", [0.1, 0.2]) == [("full", 0.1)]


def test_catalog_status(spark):
    catalog = spark.createDataFrame([("j", "The Journal"), ("k", "Lost")], "journal_id string, journal_name string")
    directory = spark.createDataFrame([("Journal", ["0378-5955", "2434-561X"]), ("The Journal", ["2434-561X", "0378-5954"])], "title string, issns array<string>")
    none = spark.createDataFrame([], "journal_id string, issns array<string>")
    # titles of one name give all their valid ISSNs, if they share one: their union, not what they share
    rows = experiment.catalog_status(catalog, directory, none).collect()
    assert sorted(map(tuple, rows)) == [("j", ["0378-5955", "2434-561X"], True, "verified", []), ("k", [], False, "unresolved", [])]
