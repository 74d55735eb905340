"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions import fixed, numeric, records, text
from winnow.operators import counts, dedup, evaluation, joins, lexical, maxscore, retrieval, rules, sampling
from winnow.shared import cut, shared_root
from winnow.sources import files, web
from winnow.streaming import limiter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers: the first line is the title, the source the journal."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("p"), "doc_id").alias("paper_id"), "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("abstract"),
        F.col("source").alias("journal_id"), (2014 + F.col("doc_id") % 14).cast("int").alias("year"), "lang", "n_chars",
    )


PAPERS = """papers AS (SELECT 'p' || doc_id AS paper_id, doc_id, split_part(text, chr(10), 1) AS title, text AS abstract, source AS journal_id,
  CAST(2014 + doc_id % 14 AS INT) AS year, lang, n_chars FROM documents)"""
YEARS = range(fixed.FIRST_YEAR, fixed.LAST_YEAR + 1)

# --- counts -------------------------------------------------------------------------------------


@query(f"WITH {PAPERS} SELECT journal_id, count(*) AS total, " + ", ".join(f'count(*) FILTER (year = {y}) AS "{y}"' for y in YEARS) + " FROM papers GROUP BY journal_id")
def counts_by_year(spark, sf_dir):
    return counts.by_year(papers(spark, sf_dir), "journal_id", "year", YEARS)


@query("""WITH n AS (SELECT source AS journal_id, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT r, CASE WHEN r % 3 = 0 THEN 'incomplete' ELSE 'complete' END AS status FROM range(25) t(r))
SELECT 'src' || r AS journal_id, status, CASE WHEN status = 'complete' THEN coalesce(n, 0) END AS publications FROM s LEFT JOIN n ON journal_id = 'src' || r""")
def counts_known_or_null(spark, sf_dir):
    n = load(spark, sf_dir, "documents").groupBy(F.col("source").alias("journal_id")).count()
    status = spark.range(25).select(F.concat(F.lit("src"), "id").alias("journal_id"), F.when(F.col("id") % 3 == 0, "incomplete").otherwise("complete").alias("status"))
    return status.join(n, "journal_id", "left").select("journal_id", "status", counts.known_count(F.col("status"), F.col("count")).alias("publications"))


@query("""SELECT user_id, CASE WHEN count(DISTINCT s) FILTER (good) > 1 OR (count(*) FILTER (good) BETWEEN 1 AND count(*) - 1) THEN 'conflicting_metadata_versions'
 WHEN count(*) FILTER (good) > 0 THEN 'accepted' ELSE arg_min(r, o) END AS outcome, count(*) AS variants,
 CASE WHEN NOT (count(DISTINCT s) FILTER (good) > 1 OR (count(*) FILTER (good) BETWEEN 1 AND count(*) - 1)) AND count(*) FILTER (good) > 0 THEN min(o) FILTER (good) END AS first_good
FROM (SELECT user_id, v, s, r, r IS NULL AS good, o FROM (SELECT user_id, event_type AS v, event_type AS s, CASE WHEN event_type <> 'purchase' THEN 'not_' || event_type END AS r, min(event_id) AS o
 FROM events GROUP BY ALL)) GROUP BY user_id""")
def metadata_variants(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    reason = F.when(F.col("event_type") != "purchase", F.concat(F.lit("not_"), "event_type"))
    return counts.resolve_variants(e, "user_id", F.col("event_type"), F.col("event_type"), reason, F.col("event_id"))


@query("""SELECT lot, CASE WHEN count(DISTINCT s) FILTER (good) > 1 OR (count(*) FILTER (good) BETWEEN 1 AND count(*) - 1) THEN 'conflicting_metadata_versions'
 WHEN count(*) FILTER (good) > 0 THEN 'accepted' ELSE arg_min(r, o) END AS outcome, count(*) AS variants,
 CASE WHEN NOT (count(DISTINCT s) FILTER (good) > 1 OR (count(*) FILTER (good) BETWEEN 1 AND count(*) - 1)) AND count(*) FILTER (good) > 0 THEN min(o) FILTER (good) END AS first_good
FROM (SELECT lot, s, r, r IS NULL AS good, o FROM (SELECT user_id * 20 + event_id % 20 AS lot, event_type AS v, value < 20 AS s, CASE WHEN event_type = 'error' OR event_type = 'signup' THEN 'not_' || event_type END AS r, min(event_id) AS o
 FROM events GROUP BY ALL)) GROUP BY lot""")
def metadata_variants_all(spark, sf_dir):
    """metadata_variants over every event: outcomes vary by column expressions, not by a choice of rows."""
    e = load(spark, sf_dir, "events").withColumn("lot", F.col("user_id") * 20 + F.col("event_id") % 20)
    reason = F.when(F.col("event_type").isin("error", "signup"), F.concat(F.lit("not_"), "event_type"))
    small = F.col("value") < 20
    return counts.resolve_variants(e, "lot", F.struct("event_type", small), small, reason, F.col("event_id"))


@query("SELECT source AS grp, bool_and(quality = 1) AS scan_complete, CASE WHEN source = 'src3' THEN 'needs_series_review' WHEN bool_and(quality = 1) THEN 'complete' ELSE 'incomplete' END AS status FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def scan_status(spark, sf_dir):
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("grp"), (F.col("quality") == 1).alias("ok"))
    return counts.completeness(rows, "grp", "ok", ["src3"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_deposit(spark, sf_dir):
    return counts.last_write(load(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), "user_id", "event_id")


# --- rules --------------------------------------------------------------------------------------

#: Openings of titles, and whether such a title is unsuitable.
_OPENINGS = [
    ("Erratum: ", True), ("Editorial ", True), ("On the contents of ", False), ("Notes, back matter ", True), ("Publisher correction ", True), ("Errata to ", True), ("Prefaces of ", False), ("", False),
    ("Corrigendum. ", True), ("The corrigenda to ", True), ("A table of contents of ", True), ("Contents ", True), ("Index to ", True), ("Index theory of ", False), ("Obituary of ", True), ("An obituary-like ", True),
    ("Front-matter ", True), ("Special issues on ", False), ("Special issue ", True), ("Retracted: ", True), ("A retraction of ", False), ("The editorial ", False), ("Author corrections ", False), ("Author index ", True),
    ("Mastheads ", False), ("LIST OF REFEREES ", True), ("Information on authors ", False), ("Issue information ", True), ("Guest editorial ", True), ("Errata, then ", True), ("On errata in ", False), ("On errata to ", True),
]
_TITLES = f"CASE p_partkey % {len(_OPENINGS)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, (t, _) in enumerate(_OPENINGS)) + " END || p_name"
_UNSUITABLE = f"p_partkey % {len(_OPENINGS)} IN ({', '.join(str(i) for i, (_, bad) in enumerate(_OPENINGS) if bad)})"


def _article_items(spark, sf_dir):
    """part rows as article records of three catalog journals."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey", F.when(k % 11 == 0, "book").otherwise("journal-article").alias("kind"), F.array(F.concat(F.lit("issn"), (k % 7).cast("string"))).alias("issns"),
        F.array(*[F.lit(f"issn{i}") for i in range(6)]).alias("catalog"), F.expr(_TITLES).alias("title"), (k % 13 == 0).alias("review"), (2010 + F.col("p_size") % 20).alias("year"),
        F.when(k % 17 == 0, "doi:").otherwise(F.concat(F.lit("https://doi.org/10.1/"), k)).alias("doi"),
    )


_REASONS = f"""reasons AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 11 = 0 THEN 'not_individual_journal_article' WHEN p_partkey % 7 = 6 THEN 'issn_mismatch'
 WHEN {_UNSUITABLE} THEN 'unsuitable_title' WHEN p_partkey % 13 = 0 THEN 'series_requires_work_level_review'
 WHEN NOT 2010 + p_size % 20 BETWEEN 2016 AND 2025 THEN 'outside_publication_window' WHEN p_partkey % 17 = 0 THEN 'missing_crossref_doi' END AS reason
 FROM part)"""


def _reasons(spark, sf_dir):
    c = F.col
    return _article_items(spark, sf_dir).withColumn("reason", rules.article_reason(c("kind"), c("issns"), c("catalog"), c("title"), c("review"), c("year"), c("doi")))


@query(f"WITH {_REASONS} SELECT p_partkey, reason FROM reasons")
def article_cascade(spark, sf_dir):
    return _reasons(spark, sf_dir).select("p_partkey", "reason")


@query(f"WITH {_REASONS} SELECT reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY reason")
def rejections_by_reason(spark, sf_dir):
    _, bad = rules.accepted_and_rejected(_article_items(spark, sf_dir), _reason_of())
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


def _reason_of():
    c = F.col
    return rules.article_reason(c("kind"), c("issns"), c("catalog"), c("title"), c("review"), c("year"), c("doi"))


@query(f"SELECT p_partkey, {_UNSUITABLE} AS unsuitable FROM part")
def unsuitable_titles(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.unsuitable_title(F.expr(_TITLES)).alias("unsuitable"))


#: Ends put to the texts: those that a pattern cuts, and those that none does.
_ENDS = [
    "", " Keywords: x MSC2010: y", " MSC: 11A11 Keywords: z", " (C) 2020 all", " 2010 Mathematics Subject Classification: q", " 11A11, 12B12 1. Introduction 7 more",
    " 1. Introduction We go on.", " The keywords are few", " Copyright by us", " copyrights", " © 2019 Us. More", " (c) 19 points",
    " See MSC2020: 05C", " An introduction to MSCs", " Then 1. Introduction to it", " A1. Introduction 12 and so on",
]
_CUT_TEXT = f"text || '.' || CASE doc_id % {len(_ENDS)} " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_ENDS)) + " END"
_SQL_CUT = _CUT_TEXT
for _p in (r"©|\(C\)\s*\d{4}|\bCopyright\b", r"\bMSC(19\d\d|20\d\d)?\s*:", r"(\b20\d\d\s+)?\bMathematics subject classification\s*:", r"\bKeywords\s*:", r"(\b\d{2}[A-Z]\d{2}(\s*[,;]\s*\d{2}[A-Z]\d{2})*\s*)?\b1\.\s*Introduction\s+\d{1,5}\b"):
    _SQL_CUT = f"regexp_replace({_SQL_CUT}, '(?is)(?:{_p}).*$', '')"
_SQL_CUT = f"regexp_replace({_SQL_CUT}, '(?is)\\.\\s*1\\.\\s*introduction\\b.*$', '.')"


@query(f"SELECT doc_id, md5({_SQL_CUT}) AS digest FROM documents")
def abstract_cuts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.cut_abstract(F.expr(_CUT_TEXT)).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 15 AS usable FROM documents")
def usable_abstracts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", (text.word_count(F.col("text")) >= fixed.LEAST_WORDS).alias("usable"))


@query()
def cleaned_papers(spark, sf_dir):
    good, log = rules.clean_papers(papers(spark, sf_dir).select("paper_id", "title", "abstract", "journal_id"))
    return log.select("paper_id", "reason", F.array_join("changed_fields", ",").alias("changed"))


# --- scalar functions ---------------------------------------------------------------------------

_DOI = "CASE s_suppkey % 4 WHEN 0 THEN 'https://doi.org/10.1/A' WHEN 1 THEN ' doi: 10.1/B' WHEN 2 THEN 'HTTP://dx.doi.org/10.1/c' ELSE '10.1/D' END || s_suppkey"
_ARXIV = "CASE s_suppkey % 4 WHEN 0 THEN 'https://arxiv.org/abs/' WHEN 1 THEN 'http://www.arxiv.org/pdf/' ELSE '' END || '2101.0000' || (s_suppkey % 9) || CASE s_suppkey % 3 WHEN 0 THEN 'v2' WHEN 1 THEN '' ELSE '.pdf' END"


@query(f"""SELECT s_suppkey, lower(regexp_replace(trim({_DOI}), '^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)', '', 'i')) AS doi,
 regexp_replace(regexp_replace(regexp_replace({_ARXIV}, '^https?://(?:www\\.)?arxiv.org/(?:abs|pdf)/', ''), '\\.pdf$', ''), 'v\\d+$', '') AS arxiv FROM supplier""")
def identifier_keys(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select("s_suppkey", text.doi_key(F.expr(_DOI)).alias("doi"), text.arxiv_key(F.expr(_ARXIV)).alias("arxiv"))


_ISSN = "concat(lpad(cast(c_custkey % 10000 as {s}), 4, '0'), '-', lpad(cast((c_custkey * 7) % 1000 as {s}), 3, '0'), CASE WHEN c_custkey % 11 = 10 THEN 'X' ELSE cast(c_custkey % 11 as {s}) END)"
_DIGIT = lambda k: f"(8 - {k}) * CASE substr(d, {k} + 1, 1) WHEN 'X' THEN 10 ELSE CAST(substr(d, {k} + 1, 1) AS INT) END"


@query(f"SELECT c_custkey, ({' + '.join(_DIGIT(k) for k in range(8))}) % 11 = 0 AS valid FROM (SELECT c_custkey, replace({_ISSN.format(s='varchar')}, '-', '') AS d FROM customer)")
def issn_checksums(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", text.valid_issn(F.expr(_ISSN.format(s="string"))).alias("valid"))


_TITLE_KEY = r"rtrim(trim(regexp_replace(replace(replace(lower(nfc_normalize(split_part(text, chr(10), 1))), 'ß', 'ss'), '&amp;', '&'), '\s+', ' ', 'g')), '.')"


@query(f"SELECT doc_id, {_TITLE_KEY} AS title_key FROM documents")
def title_keys(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", text.title_key("title").alias("title_key"))


_IP = "CASE c_custkey % 3 WHEN 0 THEN '10.0.' || (c_custkey % 200) || '.7' WHEN 1 THEN '::ffff:10.1.' || (c_custkey % 200) || '.9' ELSE '2001:db8:0:' || (c_custkey % 9 + 1) || '::' || (c_custkey % 9 + 1) END"


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '10.0.' || (c_custkey % 200) || '.7' WHEN 1 THEN '10.1.' || (c_custkey % 200) || '.9' ELSE '2001:db8:0:' || (c_custkey % 9 + 1) || '::/64' END AS client FROM customer")
def client_networks(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", text.client_key(F.expr(_IP)).alias("client"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 2000 + CAST(user_id % 20 AS INT) WHEN event_id % 4 = 1 THEN 2010 + CAST(user_id % 9 AS INT) END AS year, CASE event_id % 4 WHEN 0 THEN 'published-print' WHEN 1 THEN 'issued' END AS field FROM events")
def publication_years(spark, sf_dir):
    k, u = F.col("event_id") % 4, (F.col("user_id") % 20).cast("int")
    parts = lambda on, y: F.when(on, F.array(F.array(y.cast("int"), F.lit(1)))).otherwise(F.array().cast("array<array<int>>"))
    never = F.lit(False)
    found = records.publication_year(parts(k == 0, 2000 + u), parts(never, u), parts(never, u), parts(k <= 1, 2010 + (F.col("user_id") % 9)))
    return load(spark, sf_dir, "events").select("event_id", found["year"].alias("year"), found["field"].alias("field"))


def rebuilt_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, words): each whole text by way of its inverted index, words apart by one space."""
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    placed = documents.select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode_outer(words).alias("p", "w"))  # texts are dealt, not words
    index = placed.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.filter(F.collect_list(F.struct("w", "ps")), lambda e: e["w"].isNotNull())).alias("index"))
    return index.select("doc_id", records.from_inverted_index(F.col("index")).alias("words"))


@query(r"SELECT doc_id, md5(array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), ' ')) AS digest FROM documents")
def inverted_abstracts(spark, sf_dir):
    return rebuilt_texts(load(spark, sf_dir, "documents")).select("doc_id", F.md5(F.col("words").cast("binary")).alias("digest"))


@query("""SELECT item_id, sha256('{"item":' || item_id || ',"none":null,"half":' || CASE WHEN item_id % 2 = 0 THEN 'true' ELSE 'false' END || '}') AS digest FROM benchmark""")
def request_digests(spark, sf_dir):
    row = F.struct(F.col("item_id").alias("item"), F.lit(None).cast("string").alias("none"), (F.col("item_id") % 2 == 0).alias("half"))
    return load(spark, sf_dir, "benchmark").select("item_id", records.ordered_digest(row).alias("digest"))


# --- duplicates ---------------------------------------------------------------------------------

_EDGES = f"""WITH RECURSIVE k AS (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, 't' || {_TITLE_KEY} AS key FROM documents UNION ALL SELECT doc_id, 'd' || md5(right(text, 60)) FROM documents) WHERE key <> 't' AND key <> 'tintroduction'),
e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM (SELECT key, min(doc_id) AS doc_id FROM k GROUP BY key) b JOIN k a USING (key)),
r AS (SELECT DISTINCT x AS node, x AS seen FROM e UNION SELECT r.node, CASE WHEN e.x = r.seen THEN e.y ELSE e.x END FROM r JOIN e ON e.x = r.seen OR e.y = r.seen),
c AS (SELECT node AS doc_id, min(seen) AS root FROM r GROUP BY node)"""


def _papers_with_doi(spark, sf_dir):
    # ids padded so that their order is the documents' order
    return papers(spark, sf_dir).withColumn("doi", F.md5(F.right("abstract", F.lit(60)).cast("binary"))).withColumn("paper_id", F.lpad(F.col("doc_id").cast("string"), 12, "0"))


@query(f"{_EDGES} SELECT doc_id, root FROM c")
def duplicate_groups(spark, sf_dir):
    keyed = dedup.identities(_papers_with_doi(spark, sf_dir).select("paper_id", "title", "doi"))
    return dedup.groups(cut(keyed)).select(F.col("paper_id").cast("long").alias("doc_id"), F.col("root").cast("long").alias("root"))


@query(f"{_EDGES} SELECT arg_max(doc_id, (length(text), doc_id)) AS doc_id, count(*) AS versions FROM c JOIN documents USING (doc_id) GROUP BY root HAVING count(DISTINCT source) = 1")
def deduplicated_papers(spark, sf_dir):
    good, _ = dedup.deduplicate(_papers_with_doi(spark, sf_dir).select("paper_id", "title", "abstract", "journal_id", "doi"))
    return good.select(F.col("paper_id").cast("long").alias("doc_id"), F.size("versions").cast("long").alias("versions"))


@query(f"{_EDGES}, q AS (SELECT root FROM c JOIN documents USING (doc_id) GROUP BY root HAVING count(DISTINCT source) > 1) SELECT source AS journal_id, count(DISTINCT root) AS conflicting_groups FROM c JOIN documents USING (doc_id) SEMI JOIN q USING (root) GROUP BY source")
def quarantined_groups(spark, sf_dir):
    _, bad = dedup.deduplicate(_papers_with_doi(spark, sf_dir).select("paper_id", "title", "abstract", "journal_id", "doi"))
    return dedup.conflicts_by_journal(bad)


@query(f"{_EDGES}, g AS (SELECT root, arg_max(source, (length(text), doc_id)) AS journal_id, arg_max(CAST(2014 + doc_id % 14 AS INT), (length(text), doc_id)) AS year FROM c JOIN documents USING (doc_id) GROUP BY root HAVING count(DISTINCT source) = 1) SELECT journal_id, count(*) AS total, " + ", ".join(f'count(*) FILTER (year = {y}) AS "{y}"' for y in YEARS) + " FROM g GROUP BY journal_id")
def deduplicated_counts(spark, sf_dir):
    """The flagship: papers, deduplicated with conflicts set apart, counted by journal and year."""
    good, _ = dedup.deduplicate(_papers_with_doi(spark, sf_dir).select("paper_id", "title", "abstract", "journal_id", "doi", "year"))
    return counts.by_year(good, "journal_id", "year", YEARS)


# --- joins --------------------------------------------------------------------------------------


@query("""WITH one AS (SELECT doc_id, min(c.text) AS t FROM documents d JOIN conversations c ON c.conv_id = d.doc_id GROUP BY 1 HAVING true),
 a AS (SELECT d.doc_id, (SELECT min(c.text) FROM conversations c WHERE c.conv_id = d.doc_id AND length(c.text) >= 60) AS x, (SELECT min(b.text) FROM benchmark b WHERE b.item_id = d.doc_id AND length(b.text) >= 60) AS y, CASE WHEN length(d.text) >= 60 THEN d.text END AS z FROM documents d)
SELECT doc_id, md5(coalesce(x, y, z)) AS digest, CASE WHEN x IS NOT NULL THEN 'conversation' WHEN y IS NOT NULL THEN 'benchmark' WHEN z IS NOT NULL THEN 'document' END AS source FROM a""")
def enrichment_waterfall(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    sources = [("conversation", load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text")), ("benchmark", load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")), ("document", d.select("doc_id", "text"))]
    found = joins.waterfall(d, "doc_id", sources, lambda t: F.length(t) >= 60)
    return found.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "source")


@query("SELECT s_suppkey, any_value(c_custkey) AS c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND floor(s_acctbal / 100) = floor(c_acctbal / 100) GROUP BY s_suppkey HAVING count(*) = 1")
def unique_matches(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.floor(F.col("s_acctbal") / 100).alias("level"))
    c = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 100).alias("level"))
    return joins.unique_match(s, c, ["nation", "level"], "s_suppkey").select("s_suppkey", "c_custkey")


@query("""SELECT k, CASE WHEN av % 2 = 0 THEN 'first' WHEN bv IS NOT NULL THEN 'second' ELSE 'pending' END AS origin, CASE WHEN av % 2 = 0 THEN av WHEN bv IS NOT NULL THEN bv END AS value
FROM (SELECT c_custkey AS k, count(*) AS av FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1) FULL JOIN (SELECT o_custkey AS k, count(*) AS bv FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (k)""")
def source_precedence(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    of = lambda status: o.where(F.col("o_orderstatus") == status).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("value"))
    return joins.prefer(of("F"), of("O"), "k", F.col("value") % 2 == 0)


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def missing_customers(spark, sf_dir):
    return joins.missing(load(spark, sf_dir, "customer"), load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def without_excluded_keys(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderkey").alias("keys"))
    bad = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return joins.without_shared_keys(o, "keys", bad, "o_orderkey").select("o_orderkey")


@query("""SELECT o_custkey, coalesce(list_sort(list(v) FILTER (n = rows)), []) AS common FROM (SELECT o_custkey, v, count(DISTINCT o_orderkey) AS n, any_value(rows) AS rows FROM
 (SELECT l_orderkey AS o_orderkey, o_custkey, l_returnflag AS v, count(*) OVER () AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS rows FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) USING (o_custkey) GROUP BY 1, 2) GROUP BY 1""")
def values_in_common(spark, sf_dir):
    flags = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("flags"))
    return joins.common_values(load(spark, sf_dir, "orders").join(flags, "o_orderkey"), "o_custkey", "flags")


# --- sampling -----------------------------------------------------------------------------------


@query("""WITH n AS (SELECT source, count(*) AS w FROM documents GROUP BY 1), t AS (SELECT source, (100 - count(*) OVER ()) * (w / sum(w) OVER ()) AS share, 100 - count(*) OVER () AS rest FROM n),
 r AS (SELECT source, floor(share) AS whole, row_number() OVER (ORDER BY share - floor(share) DESC, source) AS turn, rest - sum(floor(share)) OVER () AS spare FROM t)
SELECT source, CAST(1 + whole + CASE WHEN turn <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def publication_quotas(spark, sf_dir):
    n = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("w"))
    return sampling.floor_quotas(n, "source", "w", 100)


@query("""SELECT doc_id, source, CASE WHEN turn <= 3 THEN 'validation' WHEN turn <= 8 THEN 'test' ELSE 'pool' END AS part FROM
(SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || source || ':' || doc_id), doc_id) AS turn FROM documents)""")
def seeded_split(spark, sf_dir):
    return sampling.split_parts(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", [("validation", 3), ("test", 5)])


@query("""WITH s AS (SELECT md5(text) AS h, CASE WHEN turn <= 3 THEN 'validation' WHEN turn <= 8 THEN 'test' ELSE 'pool' END AS part FROM
(SELECT text, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || source || ':' || doc_id), doc_id) AS turn FROM documents))
SELECT 'h' AS kind, h AS value, array_to_string(list_sort(list(DISTINCT part)), ',') AS parts FROM s GROUP BY h HAVING count(DISTINCT part) > 1""")
def leaks_between_parts(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("h"))
    found = sampling.overlaps(sampling.split_parts(d, "source", "doc_id", [("validation", 3), ("test", 5)]), ["h"])
    return found.select("kind", "value", F.array_join("parts", ",").alias("parts"))


@query("""WITH o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, place FROM o WHERE n <= 9 OR place IN (SELECT CAST(round_even(i * (n - 1) / 8.0, 0) AS BIGINT) FROM range(9) t(i))""")
def spread_by_length(spark, sf_dir):
    return sampling.spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", "n_chars", "doc_id", 9).select("doc_id", "lang", F.col("place").cast("long").alias("place"))


@query("""WITH n AS (SELECT source, least(count(*), 20) AS quota FROM documents GROUP BY 1) SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS t FROM documents) JOIN n USING (source) WHERE t <= quota""")
def quota_prefix(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    quota = d.groupBy("source").agg(F.least(F.count("*"), F.lit(20)).alias("quota"))
    return sampling.take_quota(d, "source", F.struct(-F.col("n_chars"), F.col("doc_id")), quota).select("doc_id")


# --- retrieval ----------------------------------------------------------------------------------

_TOKENS = r"unnest(regexp_extract_all(replace(lower(split_part(text, chr(10), 1) || chr(10) || text), 'ß', 'ss'), '[\p{L}\p{N}\p{M}_]+'))"
_TFIDF = f"""tok AS (SELECT doc_id, {_TOKENS} AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY 1, 2),
 idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
 w AS (SELECT doc_id, term, (1 + ln(n)) * idf AS w FROM tf JOIN idf USING (term)), u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w),
 s AS (SELECT q.doc_id AS query_id, d.doc_id AS id, sum(q.w * d.w) AS score FROM u q JOIN u d USING (term) WHERE q.doc_id % 100 = 0 AND d.doc_id <> q.doc_id GROUP BY 1, 2)"""


def _lexical(spark, sf_dir, group: str, k: int):
    """The k best groups of documents for each query."""
    p = papers(spark, sf_dir)
    whole = retrieval.title_and_abstract(F.col("title"), F.col("abstract"))
    index = retrieval.TfIdf(p, "doc_id", whole)
    asked = maxscore.asked(index.query_vectors(p.where("doc_id % 100 = 0"), "doc_id", whole))
    best = lexical.best_groups(index, F.col(group), asked, k)
    return best.withColumn("best", F.round("best", 6))


@query(f"WITH {_TFIDF} SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS t FROM s) WHERE t <= 5")
def lexical_neighbours(spark, sf_dir):
    scored = _lexical(spark, sf_dir, "doc_id", 5).select("query_id", F.col("grp").alias("id"), F.col("best").alias("score"))
    return evaluation.ranked(scored, "query_id", "id", "score", 5).select("query_id", "id", "score")


@query(f"""WITH {_TFIDF}, b AS (SELECT query_id, source AS grp, round(max(score), 6) AS best FROM s JOIN documents ON doc_id = id GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, grp) AS place FROM b) SELECT query_id, grp, best, CAST(place AS INT) AS place FROM r WHERE place <= 5""")
def lexical_shortlists(spark, sf_dir):
    scored = _lexical(spark, sf_dir, "journal_id", 5).withColumnRenamed("best", "score")
    return retrieval.shortlist(scored, 5).select("query_id", "grp", "best", "place")


_DENSE = """s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, d.label AS grp, list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)"""


@query(f"WITH {_DENSE} SELECT query_id, grp, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY score DESC, id) AS t FROM s) WHERE t <= 2")
def dense_evidence(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return retrieval.dense_scores(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 2, "label").select("query_id", "grp", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {_DENSE}, b AS (SELECT query_id, grp, max(score) AS best FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, grp) AS place FROM b),
 t AS (SELECT query_id, grp, place, false AS inserted FROM r WHERE place <= 3), x AS (SELECT vec_id AS query_id, label AS grp, CAST(least(3, (SELECT count(*) FROM t WHERE t.query_id = vec_id) + 1) AS BIGINT) AS place, true AS inserted FROM embeddings WHERE vec_id % 50 = 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = vec_id AND t.grp = label))
SELECT query_id, grp, CAST(place AS INT) AS place, inserted FROM (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = t.query_id AND x.place = t.place) UNION ALL SELECT * FROM x)""")
def shortlists_with_target(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0")
    scored = retrieval.dense_scores(e, asked, "vec_id", "embedding", 2, "label")
    return retrieval.shortlist(scored, 3, asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("target"))).select("query_id", "grp", "place", "inserted")


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS unit_sum FROM embeddings")
def vector_norms(spark, sf_dir):
    v = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select("vec_id", F.round(numeric.norm(v), 6).alias("norm"), F.round(numeric.total(numeric.l2_normalize(v)), 6).alias("unit_sum"))


# --- evaluation ---------------------------------------------------------------------------------

_SCORES = "scores AS (SELECT c_custkey AS paper_id, n_nationkey AS journal_id, ((c_custkey * {a} + n_nationkey * 17) % 101) / 101.0::DOUBLE AS p FROM customer, nation WHERE (c_custkey + n_nationkey) % 7 <> 0)"
_RANKS = """ranks_{n} AS (SELECT c_custkey AS paper_id, c_nationkey AS target, CASE WHEN s.p IS NOT NULL THEN 1 + (SELECT count(*) FROM scores_{n} o WHERE o.paper_id = c_custkey AND (o.p > s.p OR (o.p = s.p AND o.journal_id < c_nationkey))) END AS rank
 FROM customer LEFT JOIN scores_{n} s ON s.paper_id = c_custkey AND s.journal_id = c_nationkey)"""
_RUN = lambda n, a: _SCORES.format(a=a).replace("scores AS", f"scores_{n} AS") + ", " + _RANKS.format(n=n)


def _run(spark, sf_dir, a):
    """Scores of every customer for the nations, and the customers' own nations."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_nationkey").alias("target"))
    # the 25 nations stand for the candidates, a fixed list
    scored = c.select("paper_id", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("journal_id")).where("(paper_id + journal_id) % 7 <> 0")
    return scored.withColumn("p", F.expr(f"((paper_id * {a} + journal_id * 17) % 101) / 101.0D")), c


@query(f"WITH {_RUN('a', 31)} SELECT paper_id, target, rank FROM ranks_a")
def target_ranks(spark, sf_dir):
    return evaluation.target_ranks(*_run(spark, sf_dir, 31))


@query(f"""WITH {_RUN("a", 31)}, t AS (SELECT target, avg(coalesce(rank <= 3, false)::INT) AS m FROM ranks_a GROUP BY 1)
SELECT count(*) AS n, round(count(rank) / count(*), 9) AS candidate_recall, round(avg(coalesce(rank <= 1, false)::INT), 9) AS top1, round(avg(coalesce(rank <= 3, false)::INT), 9) AS top3, round(avg(coalesce(rank <= 5, false)::INT), 9) AS top5,
 round(avg(coalesce(1 / rank, 0)), 9) AS mrr, round(sum(coalesce(rank <= 1, false)::INT) / count(rank), 9) AS conditional_top1, round((SELECT avg(m) FROM t), 9) AS macro_top3 FROM ranks_a""")
def ranking_metrics(spark, sf_dir):
    m = evaluation.metrics(evaluation.target_ranks(*_run(spark, sf_dir, 31)))
    return m.select("n", *[F.round(c, 9).alias(c) for c in m.columns if c != "n"])


@query(f"WITH {_RUN('a', 31)} SELECT target, count(*) AS support, round(avg(coalesce(rank <= 3, false)::INT), 9) AS top3 FROM ranks_a GROUP BY 1")
def metrics_by_target(spark, sf_dir):
    return evaluation.per_target(evaluation.target_ranks(*_run(spark, sf_dir, 31))).withColumn("top3", F.round("top3", 9))


@query(f"WITH {_RUN('a', 31)}, {_RUN('b', 53)} SELECT a.paper_id, coalesce(b.rank <= 3, false)::INT - coalesce(a.rank <= 3, false)::INT AS delta FROM ranks_a a JOIN ranks_b b USING (paper_id)")
def paired_changes(spark, sf_dir):
    return evaluation.paired_top3(*(evaluation.target_ranks(*_run(spark, sf_dir, a)) for a in (31, 53)))


@query()
def paired_bootstrap(spark, sf_dir):
    return evaluation.bootstrap(paired_changes(spark, sf_dir))


@query(f"""WITH {_RUN("a", 31)}, {_RUN("b", 53)}, d AS (SELECT paper_id, max(abs(a.p - b.p)) AS d FROM scores_a a JOIN scores_b b USING (paper_id, journal_id) GROUP BY 1),
 ra AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY p DESC, journal_id) AS r FROM scores_a), rb AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY p DESC, journal_id) AS r FROM scores_b),
 x AS (SELECT paper_id, bool_or((ra.r = 1) <> (rb.r = 1)) AS t1, bool_or((ra.r <= 3) <> (rb.r <= 3)) AS t3 FROM ra JOIN rb USING (paper_id, journal_id) GROUP BY 1)
SELECT round((SELECT max(d) FROM d), 9) AS max_delta, count(*) FILTER (t1) AS top1_disagreements, count(*) FILTER (t3) AS top3_disagreements FROM x""")
def scoring_disagreement(spark, sf_dir):
    found = evaluation.disagreement(_run(spark, sf_dir, 31)[0], _run(spark, sf_dir, 53)[0])
    return found.withColumn("max_delta", F.round("max_delta", 9))


@query(f"WITH {_SCORES.format(a=31)}, e AS (SELECT paper_id, journal_id, exp(p) / sum(exp(p)) OVER (PARTITION BY paper_id) AS q FROM scores) SELECT paper_id, journal_id, round(q, 9) AS q, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY round(q, 9) DESC, journal_id) AS r FROM e) WHERE r <= 5")
def top_suggestions(spark, sf_dir):
    scores, _ = _run(spark, sf_dir, 31)
    lists = scores.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("journal_id", "p"))).alias("s"))
    soft = lists.select("paper_id", F.expr("transform(s, x -> x.journal_id)").alias("j"), numeric.softmax(F.expr("transform(s, x -> x.p)")).alias("q"))
    long = soft.select("paper_id", F.explode(F.arrays_zip("j", "q")).alias("z")).select("paper_id", F.col("z.j").alias("journal_id"), F.round("z.q", 9).alias("q"))
    return evaluation.ranked(long, "paper_id", "journal_id", "q", 5)


@query(f"WITH {_SCORES.format(a=31)}, l AS (SELECT paper_id, sum(p) AS s, count(*) AS n FROM scores GROUP BY 1) SELECT paper_id, n = 22 AS valid FROM l")
def probability_checks(spark, sf_dir):
    scores, _ = _run(spark, sf_dir, 31)
    lists = scores.groupBy("paper_id").agg(F.collect_list("p").alias("p"))
    return lists.select("paper_id", numeric.valid_probabilities(numeric.softmax(F.col("p")), 22).alias("valid"))


@query(f"WITH {_SCORES.format(a=31)}, e AS (SELECT paper_id, journal_id, p - ln(sum(exp(p)) OVER (PARTITION BY paper_id)) AS lp FROM scores) SELECT round(-avg(lp), 9) AS cross_entropy FROM e JOIN customer ON paper_id = c_custkey AND journal_id = c_nationkey")
def cross_entropy(spark, sf_dir):
    scores, targets = _run(spark, sf_dir, 31)
    sums = scores.groupBy("paper_id").agg(F.log(F.sum(F.exp("p"))).alias("z"))
    own = scores.join(targets.withColumnRenamed("target", "journal_id"), ["paper_id", "journal_id"]).join(sums, "paper_id")
    return own.agg(F.round(evaluation.cross_entropy(F.col("p") - F.col("z")), 9).alias("cross_entropy"))


_HISTORY = "history AS (SELECT user_id AS run, event_id AS epoch, value AS top3 FROM events)"


@query(f"""WITH {_HISTORY}, i AS (SELECT *, coalesce(top3 > max(top3) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved, max(top3) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM history),
 g AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS grp FROM i), b AS (SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY epoch) - 1 AS bad_checks FROM g)
SELECT run, epoch, top3, improved, best, bad_checks, epoch >= 2 AND bad_checks >= 3 AS stop FROM b""")
def early_stopping(spark, sf_dir):
    h = load(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("top3"))
    return evaluation.stopping(h, "run", "epoch", "top3")


@query(f"WITH {_HISTORY} SELECT run, arg_min(epoch, (-top3, epoch)) AS epoch, max(top3) AS top3 FROM history GROUP BY run")
def best_checkpoints(spark, sf_dir):
    h = load(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("top3"))
    return evaluation.best_checkpoint(h, "run", "epoch", "top3")


@query("SELECT p_partkey, CASE WHEN n % 8 = 0 THEN n // 16 END AS validation_every_steps, CASE WHEN n % 8 = 0 AND n % 16 = 0 THEN n // 4 END AS optimizer_steps FROM (SELECT p_partkey, p_size * 16 AS n FROM part)")
def training_schedules(spark, sf_dir):
    n = F.col("p_size") * 16
    plan = evaluation.schedule(n, F.lit(2), F.lit(0.5), F.lit(False))
    return load(spark, sf_dir, "part").select("p_partkey", plan["validation_every_steps"].alias("validation_every_steps"), plan["optimizer_steps"].alias("optimizer_steps"))


# --- sources ------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def json_lines_round_trip(spark, sf_dir):
    path = f"{shared_root(spark)}/lines-{uuid.uuid4().hex}"
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_round_trip(spark, sf_dir):
    path = f"{shared_root(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang"), path)
    return files.read_csv(spark, path, ["doc_id", "text", "lang"])


@query("""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1)) AS links, len(regexp_split_to_array(html, '(?i)<li\\b[^>]*>')) AS blocks FROM pages""")
def page_links(spark, sf_dir):
    html = F.col("html")
    return load(spark, sf_dir, "pages").select("page_id", F.size(web.links(html)).alias("links"), F.size(web.html_blocks(html, r"(?i)<li\b[^>]*>")).alias("blocks"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_properties(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT doc_id, CASE WHEN length(title) NOT BETWEEN 3 AND 2000 OR length(abstract) NOT BETWEEN 40 AND 30000 THEN 'length' WHEN lower(title) = 'introduction' THEN 'generic_title' END AS error FROM (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS abstract FROM documents)")
def query_validation(spark, sf_dir):
    _, _, error = text.query_fields(F.col("title"), F.col("abstract"))
    return papers(spark, sf_dir).select("doc_id", error.alias("error"))


# --- admission ----------------------------------------------------------------------------------


@query()
def rate_limited_requests(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    requests = e.select(F.col("event_type").alias("limiter"), F.col("user_id").cast("string").alias("client"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("t"), "event_id")
    return limiter.admit(requests, short=3600.0, long=86400.0)
