"""Further registered queries: text functions, saved pages and responses, series, and the checks of an experiment, over
rows made from the driver's tables. Their SQL states the results by itself, without the library's patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from winnow.functions import records, text
from winnow.operators import dedup, rules, sampling, series
from winnow.plans import experiment
from winnow.plans.queries import load, query
from winnow.sources import publishers, web

# --- text ---------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '. End.' WHEN 2 THEN p_name ELSE 'a ' || p_name || ' < b' END AS plain FROM part")
def abstract_texts(spark, sf_dir):
    raw = F.expr("""CASE p_partkey % 4 WHEN 0 THEN '<jats:title>Abstract</jats:title> <jats:p>' || p_name || '</jats:p>' WHEN 1 THEN 'Abstract: ' || p_name || '. Published in A Journal. End.'
        WHEN 2 THEN p_name || ' © 2020 Someone' ELSE 'a<br>' || p_name || ' &lt; b' END""")
    return load(spark, sf_dir, "part").select("p_partkey", text.clean_text(raw).alias("plain"))


@query("SELECT p_partkey, 'for 1<p<2 ' || p_name || ' < y' AS plain FROM part")
def math_texts(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.plain_math_text(F.expr("'for  1<p<2 <i>' || p_name || '</i> &lt; <mml:mi mathvariant=\"x\">y</mml:mi>'")).alias("plain"))


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') || 'eandco' AS name_key, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') || 'e' AS letters FROM supplier")
def name_keys(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", text.name_key(F.expr("'The ' || s_name || ' É & Co'")).alias("name_key"), text.normalized(F.expr(r"'<b>\\mathbf{' || s_name || '} é</b>'")).alias("letters"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '21' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 5, '0') || 'v2' WHEN 1 THEN '2101.' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END AS arxiv FROM orders")
def arxiv_identifiers(spark, sf_dir):
    raw = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN 'https://arxiv.org/abs/21' || lpad(string(o_orderkey % 12 + 1), 2, '0') || '.' || lpad(string(o_orderkey % 10000), 5, '0') || 'v2'
        WHEN 1 THEN ' 2101.' || lpad(string(o_orderkey % 10000), 4, '0') || ' ' WHEN 2 THEN 'http://arxiv.org/abs/2101.00001' ELSE '2113.00001' END""")
    return load(spark, sf_dir, "orders").select("o_orderkey", text.arxiv_id(raw).alias("arxiv"))


@query("SELECT doc_id, md5('Instruct: find' || chr(10) || 'Query:' || split_part(text, chr(10), 1) || chr(10) || text) AS digest FROM documents")
def embedding_texts(spark, sf_dir):
    sent = text.embedding_text(F.substring_index("text", "\n", 1), F.col("text"), "find")
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(sent.cast("binary")).alias("digest"))


@query("SELECT p_partkey, p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AS same FROM part")
def same_works(spark, sf_dir):
    a = (F.expr("'https://doi.org/10.1/P' || p_partkey"), F.expr("upper(p_name) || '.'"))
    b = (F.expr("'10.1/p' || if(p_partkey % 3 = 0, 'x', '') || p_partkey"), F.expr("p_name || if(p_partkey % 5 = 0, ' II', '')"))
    return load(spark, sf_dir, "part").select("p_partkey", dedup.same_work(*a, *b).alias("same"))


# --- responses and pages ------------------------------------------------------------------------


@query("SELECT 'c' || o_custkey AS \"group\", count(*) AS retrieved, count(*) + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS reported, o_custkey % 3 <> 0 AS complete FROM orders GROUP BY o_custkey")
def saved_scans(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    total = o.groupBy("o_custkey").agg((F.count("*") + F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)).alias("n"))
    pages = o.groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("page")).agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("items")).join(total, "o_custkey")
    body = F.to_json(F.struct(F.struct("items", F.col("n").alias("total-results")).alias("message")))
    return web.scan_completeness(pages.select(F.concat(F.lit("c"), "o_custkey").alias("group"), "page", body.alias("body")))


@query("SELECT 'c' || o_custkey AS \"group\", o_orderkey % 2 AS page, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS INT) AS place, o_orderkey AS id FROM orders")
def saved_items(spark, sf_dir):
    items = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"))))
    pages = load(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("page")).agg(F.to_json(F.struct(F.struct(items.alias("items")).alias("message"))).alias("body"))
    return web.pages_of_items(pages.select(F.concat(F.lit("c"), "o_custkey").alias("group"), "page", "body"), "struct<id:bigint>").select("group", "page", "place", F.col("item.id").alias("id"))


@query("SELECT s_suppkey, 'http://h/x?q=' || s_suppkey AS url, 200 AS status, s_name AS body FROM supplier")
def saved_responses(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").withColumn("url", F.concat(F.lit(web.address("http://h/x", {"api_key": "k"}) + "?q="), "s_suppkey"))
    return web.fetch_saved(s.select("s_suppkey", "url"), s.select(web.cache_key(F.col("url")).alias("key"), F.lit(200).alias("status"), F.col("s_name").alias("body")))


@query("SELECT o_custkey AS batch, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS INT) AS place, CAST(o_orderkey AS VARCHAR) AS query, 'a' || o_orderkey AS answer FROM orders")
def bulk_answers(spark, sf_dir):
    b = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("queries"))
    cache = b.select(F.sha2(F.to_json("queries"), 256).alias("key"), F.transform("queries", lambda q: F.concat(F.lit("a"), q)).alias("answers"))
    return web.bulk_lookup(b, cache)


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'first' WHEN event_id % 3 = 2 THEN 'refused' ELSE 'second' END AS body FROM events")
def fallback_bodies(spark, sf_dir):
    k = F.col("event_id") % 3
    body = web.first_available(F.when(k == 2, "refused").otherwise("first"), F.when(k == 1, 200).when(k == 2, 404).when(F.col("event_id") % 2 == 0, 503), F.lit("second"))
    return load(spark, sf_dir, "events").select("event_id", body.alias("body"))


@query("SELECT CAST(2000 + s_suppkey AS INT) AS year, 'http://j/j/' || (2000 + s_suppkey) || '/' || (6 + s_suppkey) || '-' || n || '.html' AS url, CASE n WHEN 1 THEN 'On ' || s_name ELSE 'Erratum' END AS title, n = 2 AS unsuitable FROM supplier, (VALUES (1), (2)) v(n)")
def archive_pages(spark, sf_dir):
    block = "'<a href=\"/j/' || (2000 + s_suppkey) || '/' || (6 + s_suppkey) || '-{n}.html\">x</a><td class=\"style60\"><b>{t}</b></td>'"
    body = F.expr(block.format(n=1, t="On ' || s_name || '") + " || '<hr>' || " + block.format(n=2, t="Erratum") + " || '<HR size=1>none'")
    return publishers.archive_titles(load(spark, sf_dir, "supplier").select((2000 + F.col("s_suppkey")).cast("int").alias("year"), body.alias("body")), "http://j")


@query("SELECT 'u' || s_suppkey AS url, '10.1/a,10.1/s' || s_suppkey AS dois, 'c' || s_suppkey || '=' || s_name AS contents FROM supplier")
def detail_pages(spark, sf_dir):
    body = F.expr("""'<strong>DOI :</strong> 10.1/s' || s_suppkey || ' <strong>DOI :</strong>10.1/a<div class="product__data-contents--c item-list"> <a class="z" href="c' || s_suppkey || '"><strong> <i>' || s_name || '</i></strong></a></div>'""")
    found = publishers.book_details(load(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), "s_suppkey").alias("url"), body.alias("body")))
    return found.select("url", F.array_join("dois", ",").alias("dois"), F.expr("array_join(transform(contents, c -> c.url || '=' || c.title), ',')").alias("contents"))


@query("SELECT CAST(s_suppkey AS INT) AS number, CAST(s_suppkey // 5 AS INT) AS volume, CAST(2000 + s_suppkey % 20 AS INT) AS copyright_year, CAST(s_suppkey + CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS INT) AS publisher_issue_number, s_suppkey % 4 = 0 AS publisher_number_conflict, 'http://b/MEMO/' || (s_suppkey // 5) || '/' || s_suppkey AS url FROM supplier")
def product_pages(spark, sf_dir):
    body = F.expr("""'<script>var productDetailObj = {"SeriesVolumes":[{"ProductCode":"MEMO/' || (s_suppkey div 5) || '/' || s_suppkey || '","CopyrightYear":"' || (2000 + s_suppkey % 20) || '","IssueNumber":' || (s_suppkey + if(s_suppkey % 4 = 0, 1, 0)) || '}]}; more();</script>'""")
    return publishers.product_index(load(spark, sf_dir, "supplier").select(body.alias("body")), "http://b/")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'no_categories' WHEN doc_id % 5 = 1 THEN 'out_of_scope' WHEN doc_id % 7 = 0 THEN 'no_text' WHEN length(text) > 30000 THEN 'too_long' END AS error FROM documents")
def import_errors(spark, sf_dir):
    k = F.col("doc_id")
    categories = F.when(k % 5 == 0, F.array(F.lit(""))).when(k % 5 == 1, F.array(F.lit("cs.LG"), F.lit("math.x"))).when(k % 5 == 2, F.array(F.lit("math-ph"))).otherwise(F.array(F.lit("cs.LG"), F.lit("math.CO")))
    error = publishers.import_error(F.when(k % 7 == 0, "").otherwise("T"), F.col("text"), F.lit(""), categories, ["math-ph"])
    return load(spark, sf_dir, "documents").select("doc_id", error.alias("error"))


@query("SELECT page_id, length(html) AS n FROM pages")
def bounded_pages(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("﻿"), "html").cast("binary").alias("content"))
    return publishers.bounded(p).select("page_id", F.length("body").cast("long").alias("n"))


# --- series -------------------------------------------------------------------------------------

_STATUS = "CASE WHEN p_partkey BETWEEN 50 AND 150 AND p_partkey % 14 = 0 THEN 'excluded_after_review' WHEN p_partkey % 11 = 0 THEN 'excluded_unsuitable_title' WHEN p_partkey NOT BETWEEN 50 AND 150 THEN 'outside_volume_window' WHEN p_partkey % 7 <> 0 AND p_partkey % 5 = 0 THEN 'unresolved' ELSE 'confirmed' END"
_REVIEWED = "p_partkey BETWEEN 50 AND 150 AND p_partkey % 7 = 0"


@query(f"""SELECT CAST(p_partkey AS INT) AS number, CAST(p_partkey AS INT) AS volume, '10.1/' || p_partkey AS doi, {_STATUS} AS status,
 CASE WHEN {_STATUS} = 'excluded_after_review' THEN NULL WHEN {_REVIEWED} THEN 2020 WHEN p_partkey NOT BETWEEN 50 AND 150 THEN 2000 WHEN p_partkey % 5 <> 0 THEN 2016 + p_partkey % 10 END::INT AS year,
 CASE WHEN {_REVIEWED} THEN 'page' WHEN p_partkey NOT BETWEEN 50 AND 150 OR p_partkey % 5 <> 0 THEN 'bibliographic_citation' ELSE '' END AS year_source FROM part""")
def numbered_series(spark, sf_dir):
    k, inside = F.col("p_partkey"), F.col("p_partkey").between(50, 150)
    year = F.when(~inside, 2000).when(k % 5 != 0, (2016 + k % 10).cast("int"))
    doi = F.concat(F.lit("10.1/"), k)
    r = load(spark, sf_dir, "part").select(k.cast("int").alias("number"), k.cast("int").alias("volume"), doi.alias("doi"), F.when(k % 11 == 0, "Errata").otherwise(F.col("p_name")).alias("title"), year.alias("cited_year"))
    o = load(spark, sf_dir, "part").where(inside & (k % 7 == 0)).select(k.cast("int").alias("number"), doi.alias("doi"), F.lit(2020).alias("year"), F.lit("page").alias("source_kind"), (k % 14 == 0).alias("exclude"))
    return series.numbered_works(r, o, 50, 150, 50, 150)


@query("SELECT CAST(n AS INT) AS number FROM range(1, 301) t(n) WHERE n NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0)")
def missing_works(spark, sf_dir):
    return series.missing_numbers(load(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").cast("int").alias("number")), 1, 300)


@query("""SELECT p_partkey AS number, CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE p_size + 100 END AS volume, CASE WHEN p_partkey % 3 <> 0 THEN 'i' ELSE 'r' END || p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS title
 FROM part WHERE p_partkey % 3 <> 0 OR (p_partkey % 2 = 0 AND p_size + 100 >= 120)""")
def indexed_works(spark, sf_dir):
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    index = p.where(k % 3 != 0).select(k.alias("number"), F.col("p_size").alias("volume"), F.concat(F.lit("i"), k).alias("url"))
    found = p.where(k % 2 == 0).select(k.alias("number"), (F.col("p_size") + 100).alias("volume"), F.concat(F.lit("r"), k).alias("url"), F.concat(F.lit("10.1/"), k).alias("doi"), F.col("p_name").alias("title"))
    return series.index_with_records(index, found, 120)


@query("""SELECT p_partkey AS number, n, p_partkey % 5 <> 0 AND n <> 2 AND NOT (n = 3 AND p_partkey % 2 = 0) AS accepted, p_partkey % 5 <> 0 AND n = 1 AND p_partkey % 2 = 0 AS only FROM part, (VALUES (1), (2), (3)) v(n)""")
def citation_matches(spark, sf_dir):
    p, k, n = load(spark, sf_dir, "part"), F.col("p_partkey"), F.col("n")
    works = p.select(k.alias("number"), F.col("p_name").alias("title"), F.when(k % 5 == 0, "Other").otherwise("Müller").alias("first_author"))
    m = p.select(k.alias("number"), "p_name", F.explode(F.lit([1, 2, 3])).alias("n"))
    title = F.when(n == 2, "0123456789" * 5).otherwise(F.upper("p_name"))
    m = m.select("number", "n", title.alias("match_title"), F.lit("Doe, J.; Muller, K.").alias("match_authors"), F.concat(F.lit("Memoirs 1, No. "), "number").alias("source"), F.when((n == 3) & (F.col("number") % 2 == 0), "in press").otherwise("2019").alias("year"))
    return series.citation_checks(works, m, F.col("source").startswith("Memoirs")).select("number", "n", "accepted", "only")


# --- experiment ---------------------------------------------------------------------------------


@query("SELECT 'p' || c_custkey AS paper_id, CASE c_custkey % 6 WHEN 0 THEN 'hash differs' WHEN 1 THEN 'candidates differ' WHEN 2 THEN 'target is no candidate' WHEN 3 THEN 'label differs' END AS violation FROM customer WHERE c_custkey % 6 < 4")
def request_checks(spark, sf_dir):
    catalog = load(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("journal_id"), F.col("n_name").alias("journal_name"))
    c = load(spark, sf_dir, "customer")
    candidates = experiment.ordered_candidates(catalog, 25)
    papers = c.select(F.concat(F.lit("p"), "c_custkey").alias("paper_id"), F.concat(F.lit("g"), "c_custkey").alias("group_id"), F.concat(F.lit("n"), "c_nationkey").alias("target"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("abstract"))
    made = experiment.requests(papers, candidates, "Choose.", True, lambda x: experiment.first_words(x, 768))
    k = F.substring("paper_id", 2, 20).cast("long") % 6
    other = F.when(F.col("target") == candidates[0][0], candidates[1][0]).otherwise(candidates[0][0])
    bad = made.withColumns({"request_hash": F.when(k == 0, "x").otherwise(F.col("request_hash")), "candidates": F.when(k == 1, F.reverse("candidates")).otherwise(F.col("candidates")), "target": F.when(k == 2, "none").when(k == 3, other).otherwise(F.col("target"))})
    return experiment.request_violations(bad, candidates, True)


@query("SELECT doc_id, CASE WHEN turn BETWEEN 4 AND 8 THEN NULL ELSE md5(text) END AS digest FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || source || ':' || doc_id), doc_id) AS turn FROM documents)")
def held_out_texts(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.lit("t").alias("title"), F.col("text").alias("abstract"))
    kept = experiment.without_text(sampling.split_parts(d, "source", "doc_id", [("validation", 3), ("test", 5)]))
    return kept.select("doc_id", F.md5(F.col("abstract").cast("binary")).alias("digest"))


@query("SELECT item_id, md5(text) AS digest FROM benchmark WHERE item_id % 2 = 0")
def frozen_items(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("paper_id"), "text")
    chosen = b.where("paper_id % 2 = 0").select("paper_id", records.ordered_digest(F.struct("paper_id", "text")).alias("record_sha256"))
    return experiment.frozen_selection(chosen, b).select(F.col("paper_id").alias("item_id"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0 OR o_orderstatus = 'P'")
def differing_requests(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.md5(F.col("o_orderpriority").cast("binary")).alias("request_hash"), F.col("o_orderstatus").alias("target"))
    other = o.where("paper_id % 9 <> 0").withColumn("target", F.when(F.col("target") == "P", "x").otherwise(F.col("target")))
    return experiment.request_parity(o, other).select(F.col("paper_id").alias("o_orderkey"))


@query("SELECT c_custkey AS paper_id, CASE c_custkey % 5 WHEN 0 THEN 'unexpected or missing query' WHEN 1 THEN 'target differs' WHEN 2 THEN 'probabilities are invalid' WHEN 3 THEN 'ranking differs' END AS violation FROM customer WHERE c_custkey % 5 < 4")
def prediction_checks(spark, sf_dir):
    k = F.col("c_custkey")
    p = load(spark, sf_dir, "customer").where(k % 5 != 0).select(
        k.alias("paper_id"), F.when(k % 5 == 1, "z").otherwise("a").alias("target"), F.lit(["a", "b", "c"]).alias("candidates"),
        F.when(k % 5 == 2, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.3))).otherwise(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25))).alias("probabilities"),
        F.when(k % 5 == 3, F.lit(["b", "c", "a"])).otherwise(F.lit(["b", "a", "c"])).alias("ranking"),
    )
    expected = load(spark, sf_dir, "customer").select(k.alias("paper_id"), F.lit("a").alias("target"))
    return experiment.prediction_violations(p, expected, ["a", "b", "c"])


@query("SELECT event_id FROM events WHERE event_type = 'purchase' AND value > 10 AND user_id % 2 = 0 AND event_id % 3 = 0")
def finished_runs(spark, sf_dir):
    done = F.when(F.col("event_type") == "purchase", "complete").otherwise("failed")
    runs = load(spark, sf_dir, "events").select("event_id", done.alias("status"), (F.col("value") > 10).alias("checks_pass"), (F.col("user_id") % 2).cast("string").alias("prepared_hash"), (F.col("event_id") % 3).cast("string").alias("mode"))
    return experiment.completed_runs(runs, "0", "0").select("event_id")


@query("SELECT p_partkey, p_partkey % 6 IN (0, 4) AS removed FROM part")
def refined_titles(spark, sf_dir):
    title = F.expr("CASE p_partkey % 6 WHEN 0 THEN 'Corrigendum: ' WHEN 4 THEN 'Issue information, ' ELSE 'Remarks on ' END || p_name")
    kept, removed = experiment.refine_titles(load(spark, sf_dir, "part").select("p_partkey", title.alias("title")), text.unsuitable_title(F.col("title")))
    return kept.select("p_partkey", F.lit(False).alias("removed")).unionByName(removed.select("p_partkey", F.lit(True).alias("removed")))


@query("SELECT 'n' || n_nationkey AS journal_id, CASE WHEN n_nationkey % 3 = 0 THEN '1234-5679' WHEN n_nationkey % 3 = 1 THEN '0378-5955' ELSE '' END AS issns, n_nationkey % 3 < 2 AS verified FROM nation")
def catalog_checks(spark, sf_dir):
    n, k = load(spark, sf_dir, "nation"), F.col("n_nationkey")
    directory = n.select(F.concat(F.lit("the "), F.lower("n_name")).alias("title"), F.when(k % 3 == 1, F.lit(["0378-5955", "0378-5954"])).otherwise(F.lit(["0378-5954"])).alias("issns"))
    reviewed = n.where(k % 3 == 0).select(F.concat(F.lit("n"), k).alias("journal_id"), F.lit(["1234-5679"]).alias("issns"))
    found = experiment.catalog_status(n.select(F.concat(F.lit("n"), k).alias("journal_id"), F.col("n_name").alias("journal_name")), directory, reviewed)
    return found.select("journal_id", F.array_join("issns", ",").alias("issns"), "verified")


@query("SELECT source, max(n_chars) - sum(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 2 END) AS eligible FROM documents GROUP BY source")
def eligible_records(spark, sf_dir):
    reason = F.when(F.col("doc_id") % 6 == 0, "missing_or_short_abstract").when(F.col("doc_id") % 3 == 0, "crossref_endpoint_unavailable").otherwise("unsuitable_title")
    return load(spark, sf_dir, "documents").groupBy("source").agg(rules.eligible_scanned(F.col("n_chars"), F.col("doc_id") % 2, reason).alias("eligible"))


# --- set operations -----------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) c ON c_custkey = o_custkey")
def orders_of_chosen(spark, sf_dir):
    chosen = load(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").join(chosen, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE value < 60 OR event_id % 2 = 0 GROUP BY ALL")
def union_of_scans(spark, sf_dir):
    """Two overlapping scans, each item once, by the first place it was met."""
    e = load(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    both = e.where("value < 60").unionByName(e.where("event_id % 2 = 0"))
    return both.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT DISTINCT event_type, user_id % 10 AS bucket FROM events")
def distinct_values(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("bucket")).distinct()


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CASE WHEN bool_and(l_quantity > 1) THEN 'complete' WHEN bool_or(l_quantity > 1) THEN 'partial' ELSE 'none' END AS status FROM lineitem GROUP BY ALL")
def status_rollup(spark, sf_dir):
    ok = F.col("l_quantity") > 1
    status = F.when(F.bool_and(ok), "complete").when(F.bool_or(ok), "partial").otherwise("none")
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), status.alias("status"))


@query("SELECT count(*) AS shared FROM (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 2 = 0) SEMI JOIN (SELECT md5(text) AS h FROM documents WHERE doc_id % 2 = 1) USING (h)")
def shared_texts(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("h"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("part"))
    return sampling.overlaps(d, ["h"]).agg(F.count("*").alias("shared"))
