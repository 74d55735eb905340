"""Book series: volumes and their parts reconciled, numbered works with reviewed years, citation matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import fixed, text
from winnow.sources.publishers import checked


def reconcile_volumes(cards: DataFrame, books: DataFrame, reprints: DataFrame, ignored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(works, rejected, recovered) of catalog cards (volume, kind, title, year, url), one book a volume (volume,
    title, year, url, dois, contents), reprinted volumes (volume, review) and DOIs to ignore (volume, doi).

    A volume with contents is replaced by its parts; parts without a card are recovered from the contents.
    A card that the contents lack, years that differ within a volume, a volume without contents that is not
    one book, or an ignored DOI that is gone, are errors.
    """
    kept = cards.join(reprints, "volume", "left_anti")
    parts = books.select("volume", F.col("url").alias("book_url"), F.col("year").alias("book_year"), F.col("title").alias("book_title"), F.col("dois").alias("book_dois"), "contents")
    shape = kept.groupBy("volume").agg(F.count_distinct("year").alias("years"), F.count("*").alias("cards"), F.bool_and(F.col("kind") == "Livre").alias("book"), F.collect_list(F.when(F.col("kind") == "Article", F.col("url"))).alias("articles"))
    v = shape.join(parts, "volume")
    listed = F.transform("contents", lambda c: c["url"])
    v = checked(v, (F.col("years") == 1) & (F.size(F.array_except("articles", listed)) == 0), "cards of the volume disagree with its contents:", "volume")
    v = checked(v, (F.size("contents") > 0) | ((F.col("cards") == 1) & F.col("book")), "no single book:", "volume")

    children = v.select("volume", "book_url", "book_year", F.explode("contents").alias("c")).select("volume", "book_url", "book_year", "c.url", F.col("c.title").alias("listed_title"))
    own = kept.where("kind = 'Article'").select("volume", "url", F.col("title").alias("card_title"), F.col("year").alias("card_year"))
    joined = children.join(own, ["volume", "url"], "left")
    recovered = joined.where("card_title IS NULL").select("volume", "url", F.col("listed_title").alias("title"), F.col("book_year").alias("year"), F.col("book_url").alias("year_source"))
    no_doi = F.array().cast("array<string>")
    from_parts = joined.select("volume", "url", F.coalesce("card_title", "listed_title").alias("title"), F.coalesce("card_year", "book_year").alias("year"), no_doi.alias("dois"))
    whole = v.where(F.size("contents") == 0).select("volume", F.col("book_url").alias("url"), F.col("book_title").alias("title"), F.col("book_year").alias("year"), F.col("book_dois").alias("dois"))
    works = from_parts.unionByName(whole).join(ignored.select("volume", F.col("doi").alias("_ignored")), "volume", "left").withColumn("_bad", text.unsuitable_title(F.col("title")))
    works = checked(works, F.col("_bad") | F.col("_ignored").isNull() | F.array_contains("dois", F.col("_ignored")), "reviewed DOI is gone:", "volume")
    left = F.when(F.col("_ignored").isNotNull(), F.array_remove("dois", F.col("_ignored"))).otherwise(F.col("dois"))
    doi = F.when(F.size(left) == 1, left[0]).otherwise("")
    good = works.where("NOT _bad").select("volume", "title", "year", "url", doi.alias("doi")).withColumn("paper_id", F.when(F.col("doi") != "", F.concat(F.lit("doi:"), "doi")).otherwise(F.col("url")))
    reason = lambda df, why, url: df.select("volume", F.lit(why).alias("reason"), url.alias("url"))
    rejected = reason(cards.select("volume").distinct().join(reprints, "volume", "left_semi"), "reprint", F.lit(None).cast("string"))
    rejected = rejected.unionByName(reason(v.where(F.size("contents") > 0), "enclosing_collection", F.col("book_url"))).unionByName(reason(works.where("_bad"), "unsuitable_title", F.col("url")))
    return good, rejected, recovered


def numbered_works(records: DataFrame, overrides: DataFrame, first_number: int, last_number: int, first_volume: int, last_volume: int) -> DataFrame:
    """The ledger of records (number, volume, doi, title, cited_year) with reviewed overrides (number, doi, year,
    source_kind, exclude): number, volume, doi, year, status, year_source.

    status: excluded_after_review, excluded_unsuitable_title, unresolved (in the window without a year: null,
    never a guess), confirmed or outside_volume_window. Windows of numbers and volumes must agree, an override
    must name the record's DOI, and years must fit the window.
    """
    o = overrides.select("number", F.col("doi").alias("_doi"), F.col("year").alias("_year"), F.col("source_kind").alias("_source"), F.coalesce("exclude", F.lit(False)).alias("_exclude"), F.lit(True).alias("_reviewed"))
    r = records.join(o, "number", "left")
    within = F.col("volume").between(first_volume, last_volume)
    r = checked(r, within == F.col("number").between(first_number, last_number), "windows of volume and number disagree at", "number")
    r = checked(r, F.col("_reviewed").isNull() | F.col("_doi").eqNullSafe(F.col("doi")), "reviewed DOI differs at", "number")
    year = F.when(F.col("_reviewed"), F.col("_year")).otherwise(F.col("cited_year"))
    status = (
        F.when(F.coalesce("_exclude", F.lit(False)), "excluded_after_review")
        .when(text.unsuitable_title(F.coalesce("title", F.lit(""))), "excluded_unsuitable_title")
        .when(within & year.isNull(), "unresolved")
        .when(within, "confirmed")
        .otherwise("outside_volume_window")
    )
    r = r.withColumns({"status": status, "_y": year})
    in_years = F.col("_y").between(fixed.FIRST_YEAR, fixed.LAST_YEAR)
    r = checked(r, F.coalesce(F.when(F.col("status") == "confirmed", in_years).when(F.col("status") == "outside_volume_window", ~in_years), F.lit(True)), "year contradicts the window at", "number")
    source = F.when(F.col("_reviewed"), F.col("_source")).when(F.col("cited_year").isNotNull(), "bibliographic_citation").otherwise("")
    return r.select("number", "volume", "doi", F.when(F.col("status") != "excluded_after_review", F.col("_y")).alias("year"), "status", source.alias("year_source"))


def missing_numbers(records: DataFrame, first: int, last: int) -> DataFrame:
    return records.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("number")).join(records.select("number"), "number", "left_anti")


def index_with_records(index: DataFrame, records: DataFrame, from_volume: int) -> DataFrame:
    """index (number, volume, url) with the records' doi and title; records from a volume on that the index lacks are added."""
    r = records.select("number", F.col("volume").alias("_volume"), F.col("url").alias("_url"), "doi", "title", F.lit(True).alias("_there"))
    both = index.select("number", "volume", "url", F.lit(True).alias("_listed")).join(r, "number", "full_outer")
    kept = both.where(F.col("_listed").isNotNull() | (F.col("_volume") >= from_volume))
    return kept.select("number", F.coalesce("volume", "_volume").alias("volume"), F.coalesce("url", "_url").alias("url"), "doi", "title")


def citation_checks(works: DataFrame, matches: DataFrame, series: Column) -> DataFrame:
    """matches (number, match_title, match_authors, source, year) of works (number, title, first_author), with
    title_similarity, author_match, number_match, accepted, and `only`: whether just one match of the work was accepted.

    series: a condition on `source` that it names the series.
    """
    m = matches.join(works, "number")
    families = F.transform(F.split(F.coalesce("match_authors", F.lit("")), ";"), lambda a: F.trim(F.substring_index(a, ",", 1)))
    m = m.withColumn("_family", F.explode_outer(families))
    own = m.groupBy(*[c for c in m.columns if c != "_family"]).agg(F.bool_or((text.normalized("_family") == text.normalized("first_author")) & (F.col("first_author") != "")).alias("author_match"))
    number = F.expr("regexp_like(source, concat('(?<![0-9])', number, '(?![0-9])'))")
    checked_rows = own.withColumns({"title_similarity": text.title_ratio("title", "match_title"), "number_match": F.coalesce(series & number, F.lit(False)), "author_match": F.coalesce("author_match", F.lit(False))})
    accepted = (F.col("title_similarity") >= 0.9) & F.col("author_match") & F.col("number_match") & F.coalesce(F.col("year").rlike(r"^\d{4}$"), F.lit(False))
    out = checked_rows.withColumn("accepted", accepted)
    return out.withColumn("only", F.col("accepted") & (F.count_if("accepted").over(Window.partitionBy("number")) == 1))
