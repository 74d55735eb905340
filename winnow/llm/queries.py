"""The queries opN_<name> of this subpackage's operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm import ann, ball_kmeans, boilerplate, decontam, itq, langid, merkle, packing, secrets, simhash, token_cache, toxicity, warc
from winnow.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"), keep_payload=False).where("status = 'record'")
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample=20_000, threshold=0.3)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), max_len=2048, end_id=1, keep_ids=False)


def op4_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.extract(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    joined = lambda c: F.expr(f"array_join(transform({c}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)), ',')")
    counts = [F.expr(f"size(filter(base, s -> s.kind = {k}))").cast("long").alias(f"n_{kind}") for k, kind in enumerate(secrets.PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), listed, "contaminated")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(table(spark, sf_dir, "documents"))


def op10_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_cache.count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op11_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256, seed=2)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampering(table(spark, sf_dir, "documents"))


_ALL = (op1_warc, op2_toxicity, op3_packing, op4_boilerplate, op5_secrets, op6_ann, op7_simhash, op8_decontam, op9_langid, op10_token_cache, op11_itq, op12_ball_kmeans, op13_merkle)
QUERIES = {f.__name__: f for f in _ALL}
_QUINTET = "CAST('0x' || substr(h, 5 * i + 1, 5) AS INT)"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ({_QUINTET} >> {k}) % 32 + 1, 1)" for k in (15, 10, 5, 0))
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """k-means by comparing every vector with every centroid, a step a round."""
    nearest = """SELECT id, first(c ORDER BY d, c) AS c, min(d) AS d FROM
 (SELECT e.id, c.c, list_sum(list_transform(range(1, 65), lambda i: (e.v[i] - c.v[i]) * (e.v[i] - c.v[i]))) AS d FROM e, c{t} c) GROUP BY id"""
    steps = ["e AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)"]
    steps.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM e ORDER BY h, v LIMIT {k}))")
    for t in range(rounds):
        steps.append(f"a{t} AS MATERIALIZED ({nearest.format(t=t)})")
        mean = "SELECT c, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{t} JOIN e USING (id)) GROUP BY c, i) GROUP BY c"
        steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{t} o LEFT JOIN ({mean.format(t=t)}) m USING (c))")
    steps.append(f"a AS MATERIALIZED ({nearest.format(t=rounds)})")
    return f"""WITH {", ".join(steps)} SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
 CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a JOIN e USING (id) JOIN c{rounds} f ON f.c = a.c"""


#: CRC-32 of a decimal number, bit by bit.
_CRC32 = "xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0])), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384), 4294967295), 4294967295)"
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang")) + " || " + _FIELD.format("({n})") + " || " + _FIELD.format("text") + ")"
_STEP = "SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY tree, lvl, n, pos // 2"
_FOLD = "SELECT f.doc_id, f.tree, f.lvl + 1, f.pos // 2, (f.n + 1) // 2, f.p || coalesce(s.h, ''), sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END) FROM {f} f LEFT JOIN {t} s ON s.tree = f.tree AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1"

#: The others need a tokenizer, XXH64, a classifier, regular-expression offsets or an approximate index: tests/llm holds them against brute force.
ORACLE_SQL = {
    "op1_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), r AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, strlen(html) AS payload_bytes, (SELECT string_agg({_BASE32}, '' ORDER BY i) FROM range(8) t(i)) AS payload_digest,
 CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM p JOIN r USING (h)""",
    "op8_decontam": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
 s AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0),
 windows AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM s),
 places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
 hits AS (SELECT doc_id, k, n, item FROM (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g FROM places) JOIN windows USING (n, g)),
 covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM (SELECT DISTINCT doc_id, k, n FROM hits)) GROUP BY 1),
 listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""",
    "op11_itq": """WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
 r AS (SELECT vec_id AS id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
 m AS (SELECT id, min(c) AS c FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM embeddings JOIN m ON id = vec_id LEFT JOIN n ON a = vec_id""",
    "op12_ball_kmeans": _kmeans_sql(),
    "op13_merkle": f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n,
  {_LEAF.format(n="n_chars")} AS leaf, {_LEAF.format(n=f"n_chars + CASE WHEN {_CRC32} % 7 = 0 THEN 1 ELSE 0 END")} AS read FROM documents),
 t AS (SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM d UNION ALL {_STEP.format(t="t")}),
 s AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
 u AS (SELECT '' AS tree, 0 AS lvl, pos, n, subroot AS h FROM s UNION ALL {_STEP.format(t="u")}),
 f AS (SELECT doc_id, tree, 0 AS lvl, pos, n, '' AS p, read AS h FROM d UNION ALL {_FOLD.format(f="f", t="t")}),
 g AS (SELECT doc_id, '' AS tree, 0 AS lvl, s.pos, s.n, p, f.h FROM f JOIN s USING (tree) WHERE f.n = 1 UNION ALL {_FOLD.format(f="g", t="u")})
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(g.p) AS proof_sha256, g.h AS folded_root, g.h = (SELECT h FROM u WHERE n = 1) AS verified
FROM d JOIN s USING (tree) JOIN g USING (doc_id) WHERE g.n = 1""",
}
