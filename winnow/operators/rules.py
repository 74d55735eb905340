"""Ordered acceptance and rejection rules, and what is counted about them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import fixed, text

Rule = tuple[str, Column]


def first_failing(rules: Sequence[Rule]) -> Column:
    """The reason of the first rule that fails (a null condition does not), or null."""
    return F.coalesce(*[F.when(failed, reason) for reason, failed in rules])


def last_failing(rules: Sequence[Rule]) -> Column:
    """The reason of the last rule that fails, or null: later rules override."""
    return first_failing(rules[::-1])


def accepted_and_rejected(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def article_reason(kind: Column, issns: Column, catalog_issns: Column, title: Column, in_review: Column, year: Column, doi: Column) -> Column:
    """Why an article record is not taken, if it is not."""
    return first_failing(
        [
            ("not_individual_journal_article", ~kind.eqNullSafe("journal-article")),
            ("issn_mismatch", ~F.coalesce(F.arrays_overlap(issns, catalog_issns), F.lit(False))),
            ("unsuitable_title", (F.coalesce(title, F.lit("")) == "") | text.unsuitable_title(title)),
            ("series_requires_work_level_review", in_review),
            ("outside_publication_window", ~F.coalesce(year.between(fixed.FIRST_YEAR, fixed.LAST_YEAR), F.lit(False))),
            ("missing_crossref_doi", text.doi_key(doi) == ""),
        ]
    )


def clean_papers(papers: DataFrame, quarantine: Mapping[str, str] = {}, keep_from: Mapping[str, str] = {}, cut_before: Mapping[str, str] = {}, thesis_journals: Sequence[str] = (), allow_replacement: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(cleaned papers, log): repaired, cut and stripped titles and abstracts with 15 words at least.

    The log has paper_id, reason (null for accepted rows that changed) and changed_fields. The maps are
    reviewed decisions about single records: ids to quarantine, text to start from, text to stop before.
    """
    pid, title, abstract = F.col("paper_id"), F.col("title"), F.col("abstract")
    lookup = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[pid] if m else F.lit(None).cast("string")
    exempt = {  # rules that hold for some journals, or not for some records, only
        "PhD-thesis summary, not a research article": F.col("journal_id").isin(*thesis_journals),
        "unrecoverable replacement characters in abstract": ~pid.isin(*allow_replacement),
    }
    reason = last_failing([(why, F.col(field).rlike(pattern) & exempt.get(why, F.lit(True))) for why, field, pattern in fixed.SET_ASIDE])
    marked = papers.withColumns({"_reason": F.coalesce(reason, lookup(quarantine)), "_from": lookup(keep_from), "_stop": lookup(cut_before)})
    # a reviewed decision that no longer fits its record is an error, not a rule to pass over
    fits = F.assert_true(F.instr(abstract, F.col("_from")) > 0, F.concat(F.lit("the text to start from is missing: "), pid))
    kept = F.when(F.col("_from").isNotNull() & F.col("_reason").isNull(), F.expr("substr(abstract, locate(_from, abstract))") if not keep_from else F.coalesce(fits.cast("string"), F.expr("substr(abstract, locate(_from, abstract))"))).otherwise(abstract)
    cut = marked.withColumn("_cut", kept)
    cut = cut.withColumn("_cut", F.expr("CASE WHEN _stop IS NOT NULL AND locate(_stop, _cut) > 0 THEN left(_cut, locate(_stop, _cut) - 1) ELSE _cut END"))
    stripped = cut.withColumns({"_title": text.plain_math_text(title), "_abstract": text.plain_math_text(text.cut_abstract(F.col("_cut")))})
    # by way of a generator, filters on the results stay above it, and texts are not worked on once for a filter and once for a column
    done = F.struct(F.col("_title").alias("_t"), text.drop_dangling_codes(F.col("_abstract")).alias("_a"))
    plain = stripped.select("*", F.inline(F.array(done))).drop("_title", "_abstract").withColumnsRenamed({"_t": "_title", "_a": "_abstract"})
    short = ~text.has_words(F.col("_abstract"), fixed.LEAST_WORDS) | (F.col("_title") == "")
    judged = plain.withColumn("_reason", F.coalesce("_reason", F.when(short, fixed.TOO_SHORT)))
    changed = F.array_compact(F.array(F.when(title != F.col("_title"), "title"), F.when(abstract != F.col("_abstract"), "abstract")))
    other = [c for c in papers.columns if c not in ("title", "abstract")]
    good = judged.where("_reason IS NULL").select(*other, F.col("_title").alias("title"), F.col("_abstract").alias("abstract"))
    log = judged.select("paper_id", F.col("_reason").alias("reason"), F.when(F.col("_reason").isNull(), changed).alias("changed_fields"))
    return good.select(*papers.columns), log.where((F.col("reason").isNotNull()) | (F.size("changed_fields") > 0))


def reasons_by_group(rejected: DataFrame, group: str) -> DataFrame:
    """(group, reasons): a map of counts by reason."""
    n = rejected.groupBy(group, "reason").count()
    return n.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "count")))).alias("reasons"))


def eligible_scanned(records: Column, rejected: Column, reason: Column) -> Column:
    """Records less rejections other than those for want of an abstract or of an endpoint (aggregate expression)."""
    forgiven = reason.isin("missing_or_short_abstract", "crossref_endpoint_unavailable")
    return F.max(records) - F.sum(F.when(forgiven, 0).otherwise(rejected))
