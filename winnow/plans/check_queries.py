"""Registered queries of paging, pacing, the service's guards, and the checks that refuse bad input, over rows made from
the driver's tables. Their SQL states the results by itself."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from winnow.operators import counts, evaluation, joins, sampling
from winnow.plans import experiment, gateway
from winnow.plans.queries import load, query
from winnow.shared import shared_root
from winnow.sources import files, paging
from winnow.streaming import limiter

# --- scans in pages -----------------------------------------------------------------------------

_PAGES = """pages0 AS (SELECT o_custkey AS scan, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderkey % 8 AS items FROM orders),
 pages1 AS (SELECT *, 'c' || page AS cursor, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'c' || (page - 1) ELSE 'c' || (page + 1) END AS next_cursor, CASE WHEN o_orderkey % 13 = 0 THEN 503 ELSE 200 END AS status FROM pages0),
 stops AS (SELECT *, CASE WHEN status = 503 THEN 'unavailable' WHEN sum(items) OVER (PARTITION BY scan ORDER BY page) >= 40 THEN 'cap' WHEN items = 0 THEN 'empty' WHEN items < 2 THEN 'last' WHEN next_cursor IS NULL THEN 'no_cursor' WHEN o_orderkey % 7 = 0 AND page > 1 THEN 'repeated_cursor' END AS stop FROM pages1),
 reached AS (SELECT * FROM (SELECT *, min(CASE WHEN stop IS NOT NULL THEN page END) OVER (PARTITION BY scan) AS e FROM stops) WHERE e IS NULL OR page <= e)"""


def _pages(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    k, page = F.col("o_orderkey"), F.col("page")
    number = F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    to = lambda n: F.concat(F.lit("c"), n)
    onward = F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 7 == 0, to(page - 1)).otherwise(to(page + 1))
    p = o.select(F.col("o_custkey").alias("scan"), "o_orderkey", number.alias("page"), (k % 8).alias("items"))
    return p.select("scan", "page", F.when(k % 13 == 0, 503).otherwise(200).alias("status"), to(page).alias("cursor"), onward.alias("next_cursor"), "items", F.lit(20).alias("reported"))


@query(f"WITH {_PAGES} SELECT scan, page, stop FROM reached")
def followed_pages(spark, sf_dir):
    return paging.followed(_pages(spark, sf_dir), page_size=2, cap=40).select("scan", "page", "stop")


@query(f"""WITH {_PAGES}, r AS (SELECT scan, count(*) FILTER (status = 200) AS pages, coalesce(sum(items) FILTER (status = 200), 0) AS retrieved, max(stop) AS stop FROM reached GROUP BY scan),
 e AS (SELECT *, CASE WHEN stop = 'unavailable' THEN 'unavailable' WHEN stop IS NULL OR stop IN ('no_cursor', 'repeated_cursor') THEN 'Pagination ended prematurely' WHEN pages = 0 OR retrieved < 20 THEN 'Fewer records than reported total' END AS error FROM r)
SELECT scan, pages, CAST(retrieved AS BIGINT) AS retrieved, stop, error IS NULL AND stop IN ('last', 'empty') AS complete, error FROM e""")
def scan_reports(spark, sf_dir):
    return paging.scan_report(paging.followed(_pages(spark, sf_dir), page_size=2, cap=40)).select("scan", "pages", "retrieved", "stop", F.coalesce("complete", F.lit(False)).alias("complete"), "error")


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_type = 'error')")
def asked_filters(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("place"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("status"))
    return paging.asked(e).select(F.col("place").alias("event_id"))


@query("""WITH p AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, o_orderstatus, o_orderkey FROM orders),
 e AS (SELECT *, min(CASE WHEN o_orderstatus = 'P' THEN page END) OVER (PARTITION BY g) AS e FROM p) SELECT g, page, 'u' || o_orderkey AS link, e IS NOT NULL AS complete FROM e WHERE e IS NULL OR page < e""")
def catalog_pages(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    number = F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    links = F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("u"), "o_orderkey")))
    found = paging.catalog_scan(o.select(F.col("o_custkey").alias("group"), number.alias("page"), links.alias("links")))
    return found.select(F.col("group").alias("g"), "page", F.col("links")[0].alias("link"), "complete")


# --- pacing and guards --------------------------------------------------------------------------

_T = "CAST(epoch(date_trunc('second', ts)) AS DOUBLE)"


def _t():
    return F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")


@query(f"""WITH r AS (SELECT event_type AS host, {_T} AS t, event_id FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t, event_id) AS k FROM r)
SELECT host, event_id, k * 900.0::DOUBLE + max(t - k * 900.0::DOUBLE) OVER (PARTITION BY host ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS start FROM k""")
def paced_requests(spark, sf_dir):
    r = load(spark, sf_dir, "events").select(F.col("event_type").alias("host"), _t().alias("t"), "event_id")
    return limiter.paced(r, 900.0, span=86400.0).select("host", "event_id", "start")


@query(f"""WITH RECURSIVE r AS (SELECT user_id, {_T} AS t, event_id, 3600.0 * (1 + event_id % 40) AS seconds, row_number() OVER (PARTITION BY user_id ORDER BY {_T}, event_id) AS k FROM events),
 s AS (SELECT user_id, event_id, k, true AS accepted, t + seconds AS free FROM r WHERE k = 1
 UNION ALL SELECT r.user_id, r.event_id, r.k, r.t >= s.free, CASE WHEN r.t >= s.free THEN r.t + r.seconds ELSE s.free END FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)
SELECT event_id, accepted FROM s""")
def single_flights(spark, sf_dir):
    r = load(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("service"), _t().alias("t"), "event_id", (3600.0 * (1 + F.col("event_id") % 40)).alias("seconds"))
    return limiter.single_flight(r).select("event_id", "accepted")


@query("""SELECT event_id, CASE event_id % 17 WHEN 0 THEN 503 WHEN 1 THEN 503 WHEN 2 THEN 403 WHEN 3 THEN 404 WHEN 4 THEN 200 WHEN 5 THEN 405 WHEN 6 THEN 404 WHEN 7 THEN 403 WHEN 8 THEN 403 WHEN 9 THEN 415
 WHEN 10 THEN 413 WHEN 11 THEN 413 WHEN 12 THEN 403 WHEN 13 THEN 429 WHEN 14 THEN 503 WHEN 15 THEN CASE WHEN event_id % 2 = 0 THEN 413 ELSE 200 END ELSE 200 END AS status,
 CASE event_id % 17 WHEN 0 THEN 'starting' WHEN 1 THEN 'not_configured' WHEN 2 THEN 'host' WHEN 3 THEN 'not_found' WHEN 4 THEN 'page' WHEN 5 THEN 'method' WHEN 6 THEN 'not_found' WHEN 7 THEN 'origin' WHEN 8 THEN 'origin'
 WHEN 9 THEN 'content_type' WHEN 10 THEN 'size' WHEN 11 THEN 'size' WHEN 12 THEN 'client' WHEN 13 THEN 'budget' WHEN 14 THEN 'busy' WHEN 15 THEN CASE WHEN event_id % 2 = 0 THEN 'size' END END AS guard FROM events""")
def request_guards(spark, sf_dir):
    k = F.col("event_id") % 17
    log = load(spark, sf_dir, "events").select(
        "event_id", F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "Not a host").otherwise("a.example.org").alias("site"), F.when(k == 1, "Not a host").when(k == 2, "b.example.org").otherwise("a.example.org").alias("host"),
        F.when(k.isin(3, 4), "GET").when(k == 5, "PUT").otherwise("POST").alias("method"),
        F.when(k == 3, "/secret").when(k == 4, "/index.html").when(k == 6, "/api/other").when(k == 15, "/api/import/arxiv").otherwise("/api/suggest").alias("path"),
        F.when(k == 7, F.lit(None).cast("string")).otherwise("https://a.example.org").alias("origin"), F.when(k == 8, "cross-site").alias("fetch_site"),
        F.when(k == 9, "text/plain").otherwise(" Application/JSON ; charset=utf-8").alias("content_type"),
        F.when(k == 10, "150001").when(k == 15, F.when(F.col("event_id") % 2 == 0, "2001").otherwise("2000")).otherwise("150000").alias("content_length"), F.when(k == 11, "chunked").otherwise("").alias("transfer_encoding"),
        F.when(k == 12, "unknown").otherwise("2001:db8::7").alias("client"), (k != 13).alias("allowed"), (k == 14).alias("busy"),
    )
    return gateway.judged(log, ["/index.html"]).select("event_id", "status", "guard")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'arxiv_out_of_scope' WHEN 1 THEN 'arxiv_unavailable' END AS code,
 CASE event_id % 5 WHEN 0 THEN 400 WHEN 1 THEN 503 WHEN 2 THEN 500 ELSE CASE event_id % 4 WHEN 0 THEN 400 WHEN 1 THEN 503 ELSE 200 END END AS status FROM events""")
def answer_codes(spark, sf_dir):
    k, m = F.col("event_id") % 4, F.col("event_id") % 5
    code = gateway.crossing_code(F.when(k == 0, "scope").when(k == 1, "unavailable").when(k == 2, "a message with details"))
    failure = F.when(m == 0, "invalid").when(m == 1, "unavailable").when(m == 2, "other")
    return load(spark, sf_dir, "events").select("event_id", code.alias("code"), gateway.answer_status(F.lit("/api/import/arxiv"), code, failure).alias("status"))


# --- checks that refuse -------------------------------------------------------------------------


@query("""WITH j AS (SELECT s_suppkey, c_acctbal FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey), n AS (SELECT s_suppkey, count(c_acctbal) AS found, count(*) FILTER (c_acctbal > 9000) AS accepted FROM j GROUP BY 1)
SELECT s_suppkey, found, accepted, CASE WHEN found = 0 THEN 'none' WHEN accepted = 0 THEN 'mismatch' WHEN accepted = 1 THEN 'matched' ELSE 'ambiguous' END AS outcome FROM n""")
def match_outcomes(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    return joins.match_log(s, c, ["nation"], "s_suppkey", F.col("c_acctbal") > 9000)


@query("""WITH h AS (SELECT user_id, event_id, CASE WHEN event_id % 9 = 0 THEN event_id / 2.0 ELSE event_id END AS epoch, CASE WHEN event_id % 10 = 0 THEN 1.5 WHEN event_id % 10 = 1 THEN NULL ELSE 0.5 END AS score FROM events),
 b AS (SELECT *, max(epoch) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM h)
SELECT event_id FROM b WHERE NOT coalesce(epoch > 0 AND (before IS NULL OR epoch > before) AND score BETWEEN 0 AND 1, false)""")
def refused_measurements(spark, sf_dir):
    k = F.col("event_id")
    h = load(spark, sf_dir, "events").select("user_id", "event_id", F.when(k % 9 == 0, k / 2.0).otherwise(k.cast("double")).alias("epoch"), F.when(k % 10 == 0, 1.5).when(k % 10 != 1, 0.5).alias("score"))
    return evaluation.refused_checks(h, "user_id", "event_id", "epoch", "score").select("event_id")


@query("SELECT o_orderkey AS paper_id, CASE o_orderkey % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'target differs' WHEN 2 THEN 'inputs differ' WHEN 3 THEN 'inputs differ' ELSE 'repeated' END AS violation FROM orders WHERE o_orderkey % 6 < 5")
def unpaired_queries(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    o = load(spark, sf_dir, "orders")
    run = lambda t, c, h: o.select(F.col("o_orderkey").alias("paper_id"), t.alias("target"), c.alias("candidates"), h.alias("request_hash"))
    a = run(F.lit("x"), F.lit(["x", "y"]), F.lit("h"))
    b = run(F.when(k == 1, "y").otherwise("x"), F.when(k == 2, F.lit(["y", "x"])).otherwise(F.lit(["x", "y"])), F.when(k == 3, "g").otherwise("h")).where("paper_id % 6 <> 0")
    return evaluation.unpaired(a, b.unionByName(b.where("paper_id % 6 = 4")))


@query("""WITH t AS (SELECT CAST(user_id % 5 AS DOUBLE) AS learning_rate, event_id AS epoch, round(value, 0) AS top3 FROM events),
 s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY learning_rate ORDER BY top3 DESC, epoch) AS r FROM t) WHERE r = 1) SELECT learning_rate, epoch, top3 FROM s ORDER BY top3 DESC, learning_rate, epoch LIMIT 1""")
def best_rates(spark, sf_dir):
    h = load(spark, sf_dir, "events").select((F.col("user_id") % 5).cast("double").alias("learning_rate"), F.col("event_id").alias("epoch"), F.round("value", 0).alias("top3"))
    trials = evaluation.best_checkpoint(h, "learning_rate", "epoch", "top3").withColumns({"checks_pass": F.lit(True), "mode": F.lit("screen")})
    return evaluation.best_rate(trials, [0.0, 1.0, 2.0, 3.0, 4.0]).select("learning_rate", "epoch", "top3")


@query("SELECT n_nationkey AS stratum, 400 - count(c_custkey) AS missing FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(c_custkey) < 400")
def split_shortages(spark, sf_dir):
    there = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("stratum")).agg(F.count("*").alias("available"))
    target = sampling.collection_target(F.lit(100), F.lit(200), F.lit(50), 50)
    return sampling.shortages(there, load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stratum"), target.cast("long").alias("needed")), "stratum")


@query("SELECT o_orderkey AS paper_id, CASE o_orderkey % 5 WHEN 0 THEN 'the context budget is exceeded' WHEN 1 THEN 'the context budget is exceeded' ELSE 'options were lost in encoding' END AS violation FROM orders WHERE o_orderkey % 5 < 4")
def encoding_checks(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    options = F.when(k == 2, F.array(F.lit([1, 2]))).when(k == 3, F.array(F.lit([1, 2, 3]), F.lit([1, 2, 3]))).otherwise(F.array(F.lit([1, 2, 3])))
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), (k == 0).alias("state_truncated"), F.array_repeat(F.lit(1), F.when(k == 1, 9).otherwise(8)).alias("ids"), options.alias("option_index"))
    return experiment.encoding_violations(rows, 3, 8)


@query(r"""WITH d AS (SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n FROM documents) SELECT doc_id, least(n, 768) AS query_tokens, n AS state_tokens, n + 3 AS request_tokens,
 CASE WHEN n + 3 > 300 THEN 'request exceeds its budget' WHEN n > 200 THEN 'state exceeds its budget' WHEN doc_id % 2 = 1 THEN 'choices are missing' END AS violation FROM d""")
def request_budgets(spark, sf_dir):
    """Words between spaces stand for tokens; a request is the state and three words more."""
    body = F.concat(F.lit('{"state": '), F.regexp_replace(F.to_json(F.struct(F.col("text").alias("x"))), r'^\{"x":|\}$', ""), F.lit(' , "n": 3}'))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("abstract"), body.alias("request"), F.when(F.col("doc_id") % 2 == 0, F.lit(["a", "b"])).otherwise(F.lit(["a"])).alias("candidates"))
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    made = experiment.request_lengths(rows, words).withColumn("request_tokens", F.col("state_tokens") + 3)
    bad = experiment.budget_violations(made, 2, max_state=200, max_request=300)
    return made.join(bad, "paper_id", "left").select(F.col("paper_id").alias("doc_id"), "query_tokens", "state_tokens", "request_tokens", "violation")


@query("SELECT 'm' || p_partkey AS metric, p_size * 1.0::DOUBLE AS stored, CASE p_partkey % 3 WHEN 0 THEN NULL ELSE p_size + 1e-6 END AS computed FROM part WHERE p_partkey % 3 < 2")
def metric_checks(spark, sf_dir):
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey") % 3
    stored = p.select(F.concat(F.lit("m"), "p_partkey").alias("metric"), F.col("p_size").cast("double").alias("value"))
    computed = p.where(k != 0).select(F.concat(F.lit("m"), "p_partkey").alias("metric"), (F.col("p_size") + F.when(k == 1, 1e-6).otherwise(1e-13)).alias("value"))
    return experiment.metric_differences(stored, computed)


@query("""WITH a AS (SELECT c_nationkey AS n, count(*) AS eligible, count(*) FILTER (c_acctbal < 0) AS gone FROM customer GROUP BY 1) SELECT n, eligible - gone AS eligible, 7 AS old, CASE WHEN n % 2 = 0 THEN gone + 1 ELSE gone END AS titles FROM a""")
def refined_audits(spark, sf_dir):
    c = load(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n")
    title = F.lit("unsuitable_title")
    counts_of = F.when(F.col("n") % 2 == 0, F.create_map(F.lit("issn_mismatch"), F.lit(7).cast("long"), title, F.lit(1).cast("long"))).otherwise(F.create_map(F.lit("issn_mismatch"), F.lit(7).cast("long")))
    audit = c.groupBy("n").agg(F.count("*").alias("eligible")).withColumn("rejections", counts_of)
    found = experiment.refined_audit(audit, c.where("c_acctbal < 0").select("n", title.alias("reason")), "n")
    return found.select("n", "eligible", F.col("rejections")["issn_mismatch"].cast("int").alias("old"), F.coalesce(F.col("rejections")["unsuitable_title"], F.lit(0)).alias("titles"))


@query("""SELECT n_nationkey AS n, CASE n_nationkey % 6 WHEN 0 THEN '0378-5955,2049-3630' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '2049-3630' WHEN 4 THEN '1234-5679' ELSE '0378-5955' END AS issns,
 CASE n_nationkey % 6 WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'unresolved' WHEN 3 THEN 'kept' WHEN 4 THEN 'reviewed' ELSE 'verified' END AS status, CASE n_nationkey % 6 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS others FROM nation""")
def catalog_states(spark, sf_dir):
    """Two titles that share an ISSN, two that share none, a bad ISSN, one verified before, one reviewed, one title."""
    n, k = load(spark, sf_dir, "nation"), F.col("n_nationkey")
    catalog = n.select(k.alias("journal_id"), F.col("n_name").alias("journal_name"))
    one = n.select(F.lower("n_name").alias("title"), F.when(k % 6 == 2, F.lit(["0378-5954"])).otherwise(F.lit(["0378-5955"])).alias("issns"))
    two = n.where(k % 6 < 2).select(F.concat(F.lit("The "), "n_name").alias("title"), F.when(k % 6 == 0, F.lit(["0378-5955", "2049-3630"])).otherwise(F.lit(["2049-3630"])).alias("issns"))
    reviewed = n.where(k % 6 == 4).select(k.alias("journal_id"), F.lit(["1234-5679", "1234-5670"]).alias("issns"))
    before = n.select(k.alias("journal_id"), F.lit(["2049-3630"]).alias("issns"), (k % 6 >= 3).alias("verified")).where("journal_id % 6 IN (2, 3, 4)")
    found = experiment.catalog_status(catalog, one.unionByName(two), reviewed, before)
    return found.select(F.col("journal_id").alias("n"), F.array_join("issns", ",").alias("issns"), "status", F.size("other_titles").alias("others"))


@query("SELECT CASE p_partkey % 7 WHEN 0 THEN '/' WHEN 1 THEN 'a/../' ELSE 'a..b/' END || p_partkey AS name, CASE p_partkey % 7 WHEN 0 THEN 'unsafe name' WHEN 1 THEN 'unsafe name' WHEN 2 THEN 'missing' WHEN 3 THEN 'unexpected' ELSE 'changed' END AS violation FROM part WHERE p_partkey % 7 < 6")
def manifest_checks(spark, sf_dir):
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey") % 7
    name = F.concat(F.when(k == 0, "/").when(k == 1, "a/../").otherwise("a..b/"), "p_partkey")
    listed = p.select("p_partkey", name.alias("name"), F.col("p_size").cast("long").alias("bytes"), F.sha2("p_name", 256).alias("sha256"))
    found = listed.where("p_partkey % 7 <> 2").withColumns({"bytes": F.col("bytes") + F.when(F.col("p_partkey") % 7 == 4, 1).otherwise(0), "sha256": F.when(F.col("p_partkey") % 7 == 5, "0").otherwise(F.col("sha256"))})
    return files.manifest_violations(found.drop("p_partkey"), listed.where("p_partkey % 7 <> 3").drop("p_partkey"))


# --- files and counts ---------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def copied_tables(spark, sf_dir):
    path = f"{shared_root(spark)}/copied-{uuid.uuid4().hex}"
    load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").write.parquet(f"{path}/from")
    files.copy_folder(spark, f"{path}/from", f"{path}/to")
    return spark.read.parquet(f"{path}/to")


@query("SELECT CASE WHEN c_acctbal >= 0 THEN 'accepted' ELSE 'rejected' END AS part, c_custkey FROM customer")
def separate_outputs(spark, sf_dir):
    path = f"{shared_root(spark)}/outputs-{uuid.uuid4().hex}"
    parts = {"accepted": F.col("c_acctbal") >= 0, "rejected": F.col("c_acctbal") < 0}
    files.side_outputs(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), parts, path)
    one = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("part"), "c_custkey") for name in parts]
    return one[0].unionByName(one[1])


@query("SELECT 'v' || vec_id AS paper_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def loaded_vectors(spark, sf_dir):
    path = f"{shared_root(spark)}/vectors-{uuid.uuid4().hex}"
    v = load(spark, sf_dir, "embeddings")
    v.select(F.concat(F.lit("v"), "vec_id").alias("paper_id"), "embedding", F.lit("m").alias("model"), F.lit("r").alias("revision")).write.parquet(path)
    dim = len(v.select("embedding").first()["embedding"])
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return files.load_vectors(spark, path, {"model": "m", "revision": "r"}, dim).select("paper_id", F.size("embedding").alias("dim"), F.round(total, 6).alias("total"))


@query("SELECT round((sum(value) - arg_min(value, event_id)) / (count(*) - 1) / 8, 9) AS seconds_per_record FROM events")
def mean_seconds(spark, sf_dir):
    return counts.mean_after_first(load(spark, sf_dir, "events"), "event_id", "value", 8).select(F.round("seconds_per_record", 9).alias("seconds_per_record"))
