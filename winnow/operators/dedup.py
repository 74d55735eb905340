"""Duplicate papers as connected components over shared identities, with conflicting labels set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import fixed, text
from winnow.functions.records import pair_list_digest
from winnow.operators.components import connected_components
from winnow.shared import cut

KEYS = "array<struct<kind:string,value:string>>"


def identities(papers: DataFrame) -> DataFrame:
    """papers with `keys`: (kind, value) of title (unless generic), doi, arxiv id and carried duplicate_keys; the paper_id if there is none."""
    has = lambda c: F.col(c) if c in papers.columns else F.lit(None).cast("string")
    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    keyed = papers.withColumn("_title", text.title_key(F.col("title")))
    own = F.array_compact(
        F.array(
            F.when((F.col("_title") != "") & ~F.col("_title").isin(fixed.GENERIC_TITLES), pair("title", F.col("_title"))),
            F.when(has("doi") != "", pair("doi", text.doi_key(has("doi")))),
            F.when(has("arxiv_id") != "", pair("arxiv", text.arxiv_key(has("arxiv_id")))),
        )
    )
    carried = F.coalesce(F.col("duplicate_keys").cast(KEYS), F.array().cast(KEYS)) if "duplicate_keys" in papers.columns else F.array().cast(KEYS)
    keys = F.array_sort(F.array_distinct(F.concat(own.cast(KEYS), carried)))
    return keyed.withColumn("keys", F.when(F.size(keys) > 0, keys).otherwise(F.array(pair("paper", F.col("paper_id"))).cast(KEYS))).drop("_title")


def groups(keyed: DataFrame) -> DataFrame:
    """(paper_id, root): papers that share a key, directly or through others, have one root, the least paper_id.

    A key's papers are linked to the least of them: a key of many papers is one grouped minimum, no pairs.
    """
    by_key = keyed.select("paper_id", F.explode("keys").alias("key"))
    hubs = by_key.groupBy("key").agg(F.min("paper_id").alias("hub"))
    edges = by_key.join(hubs, "key").select("paper_id", "hub")
    return connected_components(edges, "paper_id", "hub").select(F.col("node").alias("paper_id"), F.col("component").alias("root"))


def deduplicate(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(unique papers, quarantine). The paper with the longest abstract, then the greatest id, stands for its
    group, with group_id, duplicate_keys and versions; groups of several journals go to quarantine whole."""
    keyed = cut(identities(papers))
    rooted = keyed.join(groups(keyed), "paper_id")
    versions = F.coalesce(F.col("versions"), F.array().cast("array<string>")) if "versions" in papers.columns else F.array().cast("array<string>")
    size = F.length(F.coalesce("abstract", F.lit("")))
    merged = rooted.groupBy("root").agg(
        F.max_by(F.struct(*[c for c in papers.columns if c not in ("duplicate_keys", "versions")]), F.struct(size, F.col("paper_id"))).alias("best"),
        F.count_distinct("journal_id").alias("journals"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("duplicate_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("paper_id"), versions))))).alias("versions"),
    )
    good = merged.where("journals <= 1").select("best.*", F.substring(pair_list_digest("duplicate_keys"), 1, 24).alias("group_id"), "duplicate_keys", "versions")
    conflicts = merged.where("journals > 1").select("root")
    quarantine = rooted.join(conflicts, "root", "left_semi").select(F.col("root").alias("conflict"), F.lit("conflicting_journal_labels").alias("reason"), *papers.columns)
    return good, quarantine


def conflicts_by_journal(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("journal_id").agg(F.count_distinct("conflict").alias("conflicting_groups"))


def same_work(doi_a: Column, title_a: Column, doi_b: Column, title_b: Column) -> Column:
    """Two records are one work when both the identifier and the title key agree."""
    return (text.doi_key(doi_a) == text.doi_key(doi_b)) & (text.title_key(title_a) == text.title_key(title_b))
