"""Registered queries of records as sources show them: feeds, pages and cards, series of volumes, cleaned texts, shares with room, and the
settings that runs and selections must agree in. Their SQL states the results from the same rows of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from winnow.operators import rules, sampling, series
from winnow.plans import experiment
from winnow.plans.check_queries import _PAGES, _pages
from winnow.plans.queries import load, query
from winnow.shared import shared_root
from winnow.sources import files, publishers, saved_pages, web


def _new(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- documents and feeds --------------------------------------------------------------------------


@query("SELECT c_nationkey AS n, count(*) AS customers, arg_max(c_name, c_custkey) AS last FROM customer GROUP BY 1")
def json_documents(spark, sf_dir):
    """A JSON document of many lines for each nation's customers."""
    path, c = _new(spark, "documents"), load(spark, sf_dir, "customer")
    named = c.groupBy(F.col("c_nationkey").alias("n")).agg(F.count("*").alias("customers"), F.max_by("c_name", "c_custkey").alias("last"))
    text = F.to_json(F.struct(F.col("n").alias("nation"), "customers", "last"), {"pretty": "true"})
    named.select("n", text.alias("value")).repartition("n").write.partitionBy("n").text(path)
    return files.read_json_document(spark, f"{path}/n=*", "nation int, customers long, last string").select(F.col("nation").alias("n"), "customers", "last")


@query("""SELECT s_suppkey AS k, '2101.' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || 'v2' AS arxiv_id, s_name || ' & co' AS title, 's' || s_nationkey AS term,
 CASE s_suppkey % 5 WHEN 2 THEN 'another paper' WHEN 3 THEN 'another version' END AS error FROM supplier""")
def imported_feeds(spark, sf_dir):
    """A feed for each supplier, asked for by a paper's name, or by that of a version, some of them not those of the entry."""
    path, s = _new(spark, "feeds"), load(spark, sf_dir, "supplier")
    number = F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    body = F.format_string("<?xml version='1.0'?><feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/2101.%sv2</id><title>%s &amp; co</title><summary>x</summary><category term='s%d' scheme='a'/></entry></feed>", number, "s_name", "s_nationkey")
    s.select(F.col("s_suppkey").alias("k"), body.alias("value")).repartition("k").write.partitionBy("k").option("lineSep", "\n").text(path)
    entries = files.read_atom(spark, path, with_path=True).select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long").alias("k"), publishers.entry_id(F.col("id")).alias("arxiv_id"), "title", F.col("categories")[0]["term"].alias("term"))
    case = F.col("s_suppkey") % 5
    asked = s.select(F.col("s_suppkey").cast("long").alias("k"), F.concat(F.lit("2101."), F.when(case == 2, F.reverse(F.concat(number, F.lit("7")))).otherwise(number), F.when(case == 1, "v2").when(case == 3, "v1").otherwise("")).alias("requested"))
    found = entries.join(asked, "k")
    return found.select("k", "arxiv_id", "title", "term", publishers.identity_error(F.col("arxiv_id"), F.col("requested")).alias("error"))


def _answers(url: str, attempt: int):
    """A source of customers: some of its answers fail at first, some always, some are refusals; its second host has what the first lacks."""
    host, _, number = url.removeprefix("https://").partition("/")
    n = int(number)
    if host == "second":
        return 200, {}, f"other {n}"
    if n % 7 == 1 and attempt < n % 3 + 1:
        return 503, {"Retry-After": "x"}, ""
    if n % 7 == 2:
        raise TimeoutError
    return (404, {}, "gone") if n % 7 == 3 else (200, {}, f"customer {n}")


@query("""SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 2 THEN NULL WHEN 3 THEN 404 ELSE 200 END AS status, CASE WHEN c_custkey % 7 NOT IN (2, 3) THEN 'customer ' || c_custkey END AS body,
 CASE c_custkey % 7 WHEN 1 THEN 2 + c_custkey % 3 WHEN 2 THEN 5 ELSE 1 END AS attempts FROM customer WHERE c_custkey % 5 <> 0""")
def fetched_responses(spark, sf_dir):
    """Addresses of customers, of which every fifth is saved already."""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("https://host"), F.col("c_nationkey"), F.lit("/"), F.col("c_custkey")).alias("url"))
    saved = c.where("c_custkey % 5 = 0").select(web.cache_key(F.col("url")).alias("key"))
    found = web.fetch_missing(c, saved, _answers, gap=0.0, sleep=_no_wait)
    return found.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("k"), "status", "body", "attempts")


@query("""SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 3 THEN 404 ELSE 200 END AS status, CASE c_custkey % 7 WHEN 2 THEN 'other ' || c_custkey WHEN 3 THEN NULL ELSE 'customer ' || c_custkey END AS body,
 CASE c_custkey % 7 WHEN 2 THEN 'fallback' ELSE 'primary' END AS source FROM customer""")
def fallback_responses(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("https://first/"), F.col("c_custkey")).alias("url"), F.concat(F.lit("https://second/"), F.col("c_custkey")).alias("fallback"))
    return web.fetch_either(c, _answers, gap=0.0, sleep=_no_wait).select("k", "status", "body", "source")


def _no_wait(seconds: float) -> None:
    """The source of these queries is a function, which needs no pauses."""


# --- pages ----------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS paper_id, CASE c_custkey % 6 WHEN 0 THEN 'Of ' || c_name || ', & more' WHEN 2 THEN 'In ' || c_mktsegment WHEN 3 THEN 'En ' || c_mktsegment WHEN 4 THEN 'En ' || c_mktsegment ELSE '' END AS found FROM customer""")
def displayed_abstracts(spark, sf_dir):
    """Pages that show a paper under its title, under another; with its DOI in two languages, in one, without a DOI to check, with another DOI."""
    k = F.col("c_custkey") % 6
    titled = F.format_string("<p class='style12'><b>%s</b></p><h2>Abstract <blockquote dir=ltr><i>Of</i> %s, &amp; more</blockquote>", F.when(k == 0, F.upper("c_name")).otherwise("another"), "c_name")
    english = F.when(k == 2, F.format_string('<div class="product__data-resume data-english x"><p>In %s</p></div>', "c_mktsegment")).otherwise("")
    own = F.when(k == 5, "10.1/other").otherwise(F.concat(F.lit("https://doi.org/10.1/"), "c_custkey"))
    identified = F.format_string('<strong>DOI :</strong> %s<br>%s<article class="article-body edito"><p>En %s</p></article>', own, english, "c_mktsegment")
    papers = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title"), F.when(k != 4, F.concat(F.lit("10.1/"), "c_custkey")).otherwise("").alias("doi"),
        F.when(k < 2, "titled").otherwise("identified").alias("layout"), F.when(k < 2, titled).otherwise(identified).alias("body"),
    )
    return publishers.displayed_abstract(papers).select("paper_id", "found")


@query("""SELECT p_name AS title, p_brand AS authors, 2000 + p_size AS year, CASE WHEN p_partkey % 3 = 0 THEN 'Livre' ELSE 'Article' END AS kind, CAST(p_partkey AS VARCHAR) AS volume, CASE WHEN p_partkey % 2 = 0 THEN '1-9' ELSE '3-14' END AS pages, 'https://s/p?a=1&k=' || p_partkey AS url FROM part""")
def card_pages(spark, sf_dir):
    """Catalog pages, one a year, of the cards of the parts."""
    p = load(spark, sf_dir, "part")
    kind, pages = F.when(F.col("p_partkey") % 3 == 0, "Livre").otherwise("Article"), F.when(F.col("p_partkey") % 2 == 0, "1-9").otherwise("3-14")
    card = F.format_string('<a class="publication x" href="/p?a=1&amp;k=%d"><div class="publication__more_info">%s - Tome %d - pp %s - %d</div><h3 class="publication__title"><i>%s</i></h3><div class="publication__text">%s</div><div class="publication__collection">Astérisque</div></a>', "p_partkey", kind, "p_partkey", pages, F.col("p_size") + 2000, "p_name", "p_brand")
    bodies = p.select((F.col("p_size") + 2000).alias("year"), card.alias("card")).groupBy("year").agg(F.array_join(F.collect_list("card"), "\n").alias("body"))  # a page a year
    return publishers.catalog_cards(bodies, "https://s", "Astérisque")


@query("SELECT s_suppkey AS k, '2101.' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || 'v3' AS arxiv_id, s_name AS title, 'A ' || s_nationkey || ' b' AS abstract, CASE WHEN s_suppkey % 2 = 0 THEN '10.1/' || s_suppkey ELSE '' END AS doi, CASE WHEN s_suppkey % 3 = 0 THEN 'math.AG,cs.IT' ELSE 'cs.IT' END AS categories FROM supplier")
def imported_pages(spark, sf_dir):
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    number = F.lpad(k.cast("string"), 5, "0")
    subjects = F.when(k % 3 == 0, "Algebra (math.AG); X (cs.IT)").otherwise("X (cs.IT)")
    doi = F.when(k % 2 == 0, F.format_string('<meta name="citation_doi" content="10.1/%d"/>', k)).otherwise("")
    body = F.format_string('<meta name="citation_title" content="%s"/><meta name="citation_abstract" content="A  %d b"/><meta name="citation_arxiv_id" content="2101.%s"/>%s<meta property="og:url" content="https://arxiv.org/abs/2101.%sv3"/><td class="cell subjects">%s</td>', "s_name", "s_nationkey", number, doi, number, subjects)
    asked = F.concat(F.lit("2101."), number, F.when(k % 4 == 0, "v3").otherwise(""))
    found = publishers.import_page(s.select(asked.alias("requested"), body.alias("body")))
    return found.select(F.substring("arxiv_id", 6, 5).cast("long").alias("k"), "arxiv_id", "title", "abstract", "doi", F.array_join("categories", ",").alias("categories"))


# --- series ---------------------------------------------------------------------------------------

_VOLUMES = """v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'reprint' WHEN o_orderkey % 5 = 0 THEN 'book' ELSE 'parts' END AS shape, 2000 + o_custkey % 20 AS year FROM orders),
 l AS (SELECT k, year, l_linenumber AS n, 'u' || k || '.' || l_linenumber AS url, CASE WHEN l_linenumber = 4 THEN 'Erratum' ELSE 'Part ' || l_partkey END AS title
  FROM v JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) ON l_orderkey = k WHERE shape = 'parts'),
 lone AS (SELECT k FROM l GROUP BY k HAVING bool_and(n = 2))"""


@query(f"""WITH {_VOLUMES} SELECT 'work' AS list, CAST(k AS VARCHAR) AS volume, url AS id, title AS what, year FROM l WHERE n <> 4 AND k NOT IN (FROM lone)
 UNION ALL SELECT 'work', CAST(k AS VARCHAR), CASE WHEN k % 3 = 0 THEN 'b' || k ELSE 'doi:10.1/' || k END, 'Book ' || k, year FROM v WHERE shape = 'book'
 UNION ALL SELECT 'rejected', CAST(k AS VARCHAR), url, 'unsuitable_title', NULL FROM l WHERE n = 4
 UNION ALL SELECT DISTINCT 'rejected', CAST(k AS VARCHAR), 'b' || k, 'enclosing_collection', NULL FROM l WHERE k NOT IN (FROM lone)
 UNION ALL SELECT DISTINCT 'rejected', CAST(k AS VARCHAR), NULL, 'reprint', NULL FROM v JOIN lineitem ON l_orderkey = k WHERE shape = 'reprint' AND l_linenumber <> 2
 UNION ALL SELECT 'recovered', CAST(k AS VARCHAR), url, title, year FROM l WHERE n = 2 AND k NOT IN (FROM lone)""")
def reconciled_volumes(spark, sf_dir):
    """Orders as volumes, their line items as parts: those of number 2 have no card, those of number 4 an unsuitable title. Every fifth
    is one book (of two DOIs, of which one is to be ignored, where 3 divides its number), every seventh a reprint."""
    o, items = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    k = F.col("o_orderkey")
    shape = F.when(k % 7 == 0, "reprint").when(k % 5 == 0, "book").otherwise("parts")
    v = o.select(k.cast("string").alias("volume"), k, shape.alias("shape"), (2000 + F.col("o_custkey") % 20).cast("int").alias("year"))
    url = F.concat(F.lit("u"), "volume", F.lit("."), "l_linenumber")
    title = F.when(F.col("l_linenumber") == 4, "Erratum").otherwise(F.concat(F.lit("Part "), "l_partkey"))
    parts = v.where("shape <> 'book'").join(items, v["o_orderkey"] == items["l_orderkey"]).select("volume", "year", "l_linenumber", title.alias("title"), url.alias("url"))
    cards = parts.where("l_linenumber <> 2").select("volume", F.lit("Article").alias("kind"), "title", "year", "url")
    cards = cards.unionByName(v.where("shape = 'book'").select("volume", F.lit("Livre").alias("kind"), F.lit("x").alias("title"), "year", F.concat(F.lit("b"), "volume").alias("url")))
    listed = parts.groupBy("volume").agg(F.collect_list(F.struct("url", "title")).alias("contents"))
    doi = F.concat(F.lit("10.1/"), "volume")
    dois = F.when(k % 3 == 0, F.array(doi, F.lit("10.1/b"), F.lit("10.1/c"))).otherwise(F.array(doi, F.lit("10.1/old")))
    entry = "array<struct<url:string,title:string>>"
    books = v.join(listed, "volume", "left").select("volume", F.concat(F.lit("Book "), "volume").alias("title"), "year", F.concat(F.lit("b"), "volume").alias("url"), dois.alias("dois"), F.coalesce("contents", F.array().cast(entry)).alias("contents"))
    reprints = v.where("shape = 'reprint'").select("volume", F.lit("seen").alias("review"))
    ignored = v.where("shape = 'book' AND o_orderkey % 3 <> 0").select("volume", F.lit("10.1/old").alias("doi"))
    works, rejected, recovered = series.reconcile_volumes(cards, books, reprints, ignored)
    row = lambda df, name, what, year: df.select(F.lit(name).alias("list"), "volume", what[0].alias("id"), what[1].alias("what"), year.cast("int").alias("year"))
    out = row(works, "work", (F.col("paper_id"), F.col("title")), F.col("year"))
    out = out.unionByName(row(rejected, "rejected", (F.col("url"), F.col("reason")), F.lit(None)))
    return out.unionByName(row(recovered, "recovered", (F.col("url"), F.col("title")), F.col("year")))


@query(f"""WITH {_PAGES.replace('page > 1 THEN', 'true THEN')} SELECT CAST(scan AS VARCHAR) AS scan, count(*) AS pages, CAST(coalesce(sum(items) FILTER (status = 200), 0) AS BIGINT) AS items
 FROM reached GROUP BY scan HAVING count(*) FILTER (page = 1 AND status = 200) = 1""")
def whole_scans(spark, sf_dir):
    """Scans whose first page says how many items they give; a scan that gave another number would end the query."""
    path, pages = _new(spark, "pages"), _pages(spark, sf_dir).withColumn("next_cursor", F.regexp_replace("next_cursor", "^c0$", "c1"))
    saved_pages.save_pages(pages, f"{path}/all")
    got = saved_pages.read_scans(spark, f"{path}/all", first="c1", pageSize=2, cap=40).where("status < 400").groupBy("scan").agg(F.sum("items").alias("reported"))
    told = pages.withColumn("scan", F.col("scan").cast("string")).drop("reported").join(got, "scan")
    started = told.where("page = 1 AND status < 400").select("scan")
    saved_pages.save_pages(told.join(started, "scan", "left_semi"), f"{path}/told")
    found = saved_pages.read_scans(spark, f"{path}/told", first="c1", pageSize=2, cap=40, whole="true")
    return found.groupBy("scan").agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.when(F.col("status") < 400, F.col("items"))), F.lit(0)).alias("items"))


# --- texts and shares -----------------------------------------------------------------------------

_WORDS = "'words ' || repeat('of the text ', 6) || md5(text)"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'award notice' WHEN doc_id % 9 = 1 THEN 'insufficient text after conservative cleanup' WHEN doc_id % 9 = 2 AND doc_id < 200 THEN 'a reviewed reason' WHEN doc_id % 9 = 8 THEN 'special-issue introduction' END AS reason,
 CASE WHEN doc_id % 9 = 3 THEN 'abstract' WHEN doc_id % 9 = 4 THEN 'title' WHEN doc_id % 9 = 5 THEN 'title,abstract' WHEN doc_id % 9 = 6 AND doc_id < 200 THEN 'abstract' END AS changed,
 CASE WHEN doc_id % 9 IN (3, 4, 5, 7) OR doc_id % 9 = 6 AND doc_id < 200 OR doc_id % 9 = 2 AND doc_id >= 200 THEN md5({_WORDS}) WHEN doc_id % 9 = 6 THEN md5('Not of it. ' || {_WORDS}) END AS abstract FROM documents""")
def cleaned_records(spark, sf_dir):
    """Records of nine kinds: set aside by title, too short, set aside after review, cut, of a title in markup, both, begun elsewhere after
    review, clean, and set aside by abstract. Reviewed decisions are about single records: those of ids below 200."""
    d, k = load(spark, sf_dir, "documents"), F.col("doc_id") % 9
    words = F.expr(_WORDS)
    title = F.when(k == 0, "The Paper Award 2019").when(k.isin(4, 5), "On <i>it</i>").otherwise("On it")
    abstract = F.when(k == 1, "too few words").when(k == 3, F.concat(words, F.lit(" Keywords: a, b"))).when(k == 5, F.concat(F.lit("<p>"), words, F.lit("</p> 11A11")))
    abstract = abstract.when(k == 6, F.concat(F.lit("Not of it. "), words)).when(k == 8, F.concat(F.lit("This special issue "), words)).otherwise(words)
    papers = d.select(F.col("doc_id").cast("string").alias("paper_id"), title.alias("title"), abstract.alias("abstract"), F.lit("j").alias("journal_id"))
    quarantine, keep_from = {str(i): "a reviewed reason" for i in range(2, 200, 9)}, {str(i): "words of" for i in range(6, 200, 9)}
    there = {r[0] for r in papers.where(F.col("paper_id").isin(*quarantine, *keep_from)).select("paper_id").collect()}  # 44 rows at most
    good, log = rules.clean_papers(papers, *({i: x for i, x in m.items() if i in there} for m in (quarantine, keep_from)))
    told = log.select("paper_id", "reason", F.array_join("changed_fields", ",").alias("changed"))
    left = papers.select("paper_id").join(told, "paper_id", "left").join(good.select("paper_id", F.md5(F.col("abstract").cast("binary")).alias("abstract")), "paper_id", "left")
    return left.select(F.col("paper_id").cast("long").alias("doc_id"), "reason", "changed", "abstract")


def _shares_sql(total: int, rounds: int = 8) -> str:
    """Shares by weight with room, a round a step: whole parts, then single units by falling remainder; a step with nothing left changes nothing."""
    steps = ["s0 AS MATERIALIZED (SELECT c_nationkey AS n, CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) * (1 + c_nationkey % 4) AS w, least(count(*), 3 + 7 * (c_nationkey % 5)) AS room, CAST(0 AS BIGINT) AS quota FROM customer GROUP BY 1)"]
    for i in range(rounds):
        steps.append(f"""l{i} AS (SELECT least({total} - sum(quota), sum(room)) AS rest, sum(w) FILTER (room > 0) AS w, count(*) FILTER (room > 0) AS n FROM s{i}),
 h{i} AS (SELECT s.n, s.w, s.room, s.quota, l.rest, CASE WHEN room > 0 THEN l.rest * (CASE WHEN l.w > 0 THEN s.w / l.w ELSE 1.0 / l.n END) ELSE 0 END AS share FROM s{i} s, l{i} l),
 p{i} AS (SELECT *, CAST(least(room, floor(share)) AS BIGINT) AS part FROM h{i}),
 t{i} AS (SELECT *, rest - sum(part) OVER () AS spare, row_number() OVER (PARTITION BY room > part ORDER BY share % 1 DESC, n) AS turn FROM p{i}),
 s{i + 1} AS MATERIALIZED (SELECT n, w, CAST(room - gain AS BIGINT) AS room, CAST(quota + gain AS BIGINT) AS quota FROM (SELECT *, part + CASE WHEN room > part AND turn <= spare THEN 1 ELSE 0 END AS gain FROM t{i}))""")
    return f"WITH {', '.join(steps)} SELECT n, quota FROM s{rounds}"


@query(_shares_sql(260))
def capped_shares(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), F.col("c_nationkey")
    strata = c.groupBy(n.alias("n")).agg((F.count_if(F.col("c_acctbal") > 0).cast("double") * (1 + F.first(n) % 4)).alias("w"), F.least(F.count("*"), 3 + 7 * (F.first(n) % 5)).alias("room"))
    return sampling.quotas(strata, "n", "w", "room", 260)


# --- settings and stages --------------------------------------------------------------------------


@query("""SELECT 'k' || p_partkey AS name FROM part WHERE p_partkey % 10 <> 9 AND (p_partkey % 5 = 1 OR p_partkey % 5 = 2 OR p_partkey % 5 = 3)""")
def changed_settings(spark, sf_dir):
    """Settings of two runs: of five one differs, one is gone, one is new, two are the same; every tenth does not matter."""
    p, k = load(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat(F.lit("k"), k).alias("name")
    before = p.where(k % 5 != 3).select(name, F.col("p_size").cast("string").alias("value"))
    now = p.where(k % 5 != 2).select(name, F.when(k % 5 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string").alias("value"))
    return experiment.changed_settings(before, now, F.col("name").rlike("9$"))


@query("""WITH s AS (SELECT n_nationkey AS place, CASE WHEN n_regionkey = 1 THEN 24 - n_nationkey ELSE n_nationkey END AS other FROM nation)
SELECT place, a.n_name AS saved, b.n_name AS found FROM s JOIN nation a ON a.n_nationkey = place LEFT JOIN nation b ON b.n_nationkey = other WHERE place <> other""")
def moved_candidates(spark, sf_dir):
    """Places of a catalog at which another candidate stands than a selection was saved with."""
    n = load(spark, sf_dir, "nation")
    saved = n.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("candidate"))
    other = n.select(F.when(F.col("n_regionkey") == 1, 24 - F.col("n_nationkey")).otherwise(F.col("n_nationkey")).alias("from"), F.col("n_nationkey").alias("place"))
    found = other.join(saved.withColumnRenamed("place", "from"), "from").select("place", "candidate")
    return experiment.order_differences(saved, found)


_RUNS = "SELECT event_type AS h, CASE user_id % 3 WHEN 0 THEN 'pilot' WHEN 1 THEN 'screen' ELSE 'full' END AS mode, (user_id % 5) / 10.0::DOUBLE AS rate, event_id AS epoch, round(value, 2) AS top3, event_id % 40 < 37 AS ok FROM events"


@query(f"""WITH r AS ({_RUNS}), d AS (SELECT * FROM r WHERE ok AND NOT (h = 'error' AND mode = 'pilot') AND NOT (h = 'click' AND rate > 0.15 AND mode = 'screen') AND NOT (h = 'view' AND mode = 'full')),
 h AS (SELECT DISTINCT h FROM r), rates AS (SELECT * FROM (VALUES (0.0), (0.1), (0.2), (0.3), (0.4)) t(rate)),
 p AS (SELECT h, bool_or(mode = 'pilot') AS pilot, bool_or(mode = 'full') AS full_run FROM h LEFT JOIN d USING (h) GROUP BY h),
 open AS (SELECT p.h, rate FROM p, rates WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.h = p.h AND mode = 'screen' AND abs(d.rate - rates.rate) < 1e-9)),
 best AS (SELECT h, rate FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY top3 DESC, rate, epoch) AS k FROM d WHERE mode = 'screen') WHERE k = 1)
SELECT h, 'pilot' AS stage, CAST(NULL AS DOUBLE) AS rate FROM p WHERE pilot IS NOT TRUE
UNION ALL SELECT h, 'screen', CAST(rate AS DOUBLE) FROM open JOIN p USING (h) WHERE pilot
UNION ALL SELECT h, 'full', rate FROM best JOIN p USING (h) WHERE pilot AND full_run IS NOT TRUE AND h NOT IN (SELECT h FROM open)""")
def next_stages(spark, sf_dir):
    """Events as a log of runs of each kind of input: what may run next for it."""
    e, u = load(spark, sf_dir, "events"), F.col("user_id")
    mode = F.when(u % 3 == 0, "pilot").when(u % 3 == 1, "screen").otherwise("full")
    log = e.select(F.col("event_type").alias("prepared_hash"), mode.alias("mode"), ((u % 5) / 10.0).alias("learning_rate"), F.col("event_id").alias("epoch"), F.round("value", 2).alias("top3"), (F.col("event_id") % 40 < 37).alias("checks_pass"))
    log = log.where("NOT (prepared_hash = 'error' AND mode = 'pilot') AND NOT (prepared_hash = 'click' AND learning_rate > 0.15 AND mode = 'screen') AND NOT (prepared_hash = 'view' AND mode = 'full')").withColumn("status", F.lit("complete"))
    hashes = [r[0] for r in e.select("event_type").distinct().collect()]  # kinds of events
    stages = [(h, stage, rate) for h in hashes for stage, rate in experiment.open_stages(log, h, [0.0, 0.1, 0.2, 0.3, 0.4])]
    return spark.createDataFrame(stages, "h string, stage string, rate double")
