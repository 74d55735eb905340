"""Publisher pages and import pages as rows. A page that cannot be read whole fails the query: every
function asserts what it relies on, so nothing is silently left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions import fixed, text


def checked(df: DataFrame, ok: Column, what: str, *shown: str) -> DataFrame:
    """df; reading it fails where ok does not hold."""
    said = F.concat_ws(" ", F.lit(what), *[F.col(c).cast("string") for c in shown])
    return df.where(F.assert_true(F.coalesce(ok, F.lit(False)), said).isNull())


def archive_titles(pages: DataFrame, base: str, first_volume_year: int = 1994) -> DataFrame:
    """(year, url, title, unsuitable) of archive pages (year, body): blocks between rules pair one link with one title."""
    link = F.concat(F.lit('(?i)<a\\b[^>]*href="('), F.replace(F.replace(F.lit(fixed.ARCHIVE_LINK), F.lit("{year}"), F.col("year").cast("string")), F.lit("{volume}"), (F.col("year") - first_volume_year).cast("string")), F.lit(')"'))
    p = pages.withColumn("_link", link)
    all_links = F.array_distinct(F.regexp_extract_all("body", F.col("_link")))
    p = checked(p.withColumn("_n", F.size(all_links)), F.col("_n") > 0, "no articles in the archive of", "year")
    blocks = p.select("year", "_n", "_link", F.explode(F.split("body", fixed.ARCHIVE_RULE)).alias("block"))
    found = blocks.select("year", "_n", F.array_distinct(F.regexp_extract_all("block", F.col("_link"))).alias("urls"), F.regexp_extract_all("block", F.lit(fixed.ARCHIVE_TITLE)).alias("titles")).where(F.size("urls") > 0)
    found = checked(found, (F.size("urls") == 1) & (F.size("titles") == 1), "links and titles do not pair in the archive of", "year")
    rows = found.select("year", F.concat(F.lit(base), F.col("urls")[0]).alias("url"), text.clean_text(F.col("titles")[0]).alias("title"))
    rows = checked(rows, F.col("title") != "", "empty title at", "url")
    return rows.withColumn("unsuitable", text.unsuitable_title(F.col("title")))


def catalog_cards(pages: DataFrame, base: str, collection: str) -> DataFrame:
    """(title, authors, year, kind, volume, pages, url) of the cards of catalog pages (year, body). A url that
    appears twice is an error."""
    card = pages.select("year", F.explode(F.regexp_extract_all("body", F.lit(fixed.CARD), F.lit(0))).alias("card"))
    part = lambda name: text.clean_text(F.regexp_extract("card", fixed.CARD_PART.replace("{part}", name), 1))
    c = card.select("year", part("title").alias("title"), part("text").alias("authors"), part("more_info").alias("info"), part("collection").alias("collection"), F.regexp_extract("card", 'href="([^"]+)"', 1).alias("href"))
    group = lambda k: F.regexp_extract("info", fixed.CARD_INFO, k)
    c = checked(c, (group(4) == F.col("year").cast("string")) & F.col("collection").contains(collection), "unexpected card", "info")
    url = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("href", "^/", "")))
    rows = c.select("title", "authors", "year", group(1).alias("kind"), group(2).alias("volume"), group(3).alias("pages"), F.replace(url, F.lit("&amp;"), F.lit("&")).alias("url"))
    return checked(rows.withColumn("_n", F.count("*").over(Window.partitionBy("url"))), F.col("_n") == 1, "a card appears twice:", "url").drop("_n")


def product_index(pages: DataFrame, base: str) -> DataFrame:
    """(number, volume, copyright_year, publisher_issue_number, publisher_number_conflict, url) from the JSON
    object that product pages (body) assign. A number that repeats, or a code of another shape, is an error."""
    start = F.regexp_instr("body", F.lit(fixed.PRODUCT))
    tail = F.expr("substr(body, _start)")
    p = checked(pages.withColumn("_start", start), F.col("_start") > 0, "no product metadata")
    # the object opens the rest; a parser that stops at its end ignores what follows
    volumes = F.get_json_object(F.regexp_replace(tail, r"^[^{]*", ""), "$.SeriesVolumes")
    entry = "array<struct<ProductCode:string,CopyrightYear:string,IssueNumber:int>>"
    e = p.select(F.explode(F.from_json(volumes, entry)).alias("e")).select("e.*")
    e = checked(e, F.col("ProductCode").rlike(fixed.PRODUCT_CODE), "series code", "ProductCode")
    code = lambda k: F.regexp_extract("ProductCode", fixed.PRODUCT_CODE, k).cast("int")
    rows = e.select(
        code(2).alias("number"), code(1).alias("volume"), F.col("CopyrightYear").cast("int").alias("copyright_year"), F.col("IssueNumber").alias("publisher_issue_number"),
        (code(2) != F.col("IssueNumber")).alias("publisher_number_conflict"), F.concat(F.lit(base), "ProductCode").alias("url"),
    )
    once = rows.groupBy("number").agg(F.first(F.struct(*[c for c in rows.columns if c != "number"])).alias("r"), F.count("*").alias("_n"))
    return checked(once, F.col("_n") == 1, "repeated number", "number").select("number", "r.*")


def book_details(pages: DataFrame) -> DataFrame:
    """(url, dois, contents) of detail pages (url, body): displayed DOIs, sorted, and contents entries (url, title)."""
    entry = lambda x: F.struct(F.regexp_extract(x, 'href="([^"]+)"', 1).alias("url"), F.trim(F.regexp_replace(F.regexp_extract(x, fixed.CONTENTS_TITLE, 1), "<[^>]*>", "")).alias("title"))
    d = pages.select("url", F.array_sort(F.array_distinct(F.regexp_extract_all("body", F.lit(fixed.DISPLAYED_DOI)))).alias("dois"), F.transform(F.regexp_extract_all("body", F.lit(fixed.CONTENTS_ITEM)), entry).alias("contents"))
    return checked(d, F.forall("contents", lambda c: c["title"] != ""), "untitled contents at", "url")


def bounded(pages: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """Binary pages (content) with `body`; larger ones, other encodings than UTF-8 and NULs are refused."""
    body = F.try_validate_utf8(F.col("content").cast("string"))
    p = pages.withColumn("body", F.regexp_replace(body, "^﻿", ""))
    return checked(p, (F.octet_length("content") <= limit) & F.col("body").isNotNull() & ~F.col("body").contains("\0"), "page refused")


def import_page(pages: DataFrame) -> DataFrame:
    """(requested, arxiv_id, title, abstract, doi, categories) of abstract pages (requested, body): the citation
    tags must stand once each, name the requested paper (and version, if one was asked), and the page must
    have one cell of subjects."""
    tag = lambda name: F.regexp_extract_all("body", F.lit(fixed.CITATION_TAG.replace("{name}", name)))
    names = ["citation_title", "citation_abstract", "citation_arxiv_id", "citation_doi", "og:url"]
    t = pages.select("requested", *[tag(n).alias(n.replace(":", "_")) for n in names], F.regexp_extract_all("body", F.lit(fixed.SUBJECTS_CELL)).alias("cells"))
    t = checked(t, F.expr(" AND ".join(f"size({n.replace(':', '_')}) <= 1" for n in names)), "ambiguous tags for", "requested")
    first = lambda c: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(""))
    r = t.select("requested", text.arxiv_id(first("og_url")).alias("arxiv_id"), first("citation_arxiv_id").alias("cited"), *[text.collapse(first(f"citation_{c}")).alias(c) for c in ("title", "abstract", "doi")], "cells")
    base = lambda c: F.regexp_replace(c, fixed.ARXIV_VERSION, "")
    same = (base("arxiv_id") == base("requested")) & (base("cited") == base("requested")) & (~F.col("requested").rlike(fixed.ARXIV_VERSION) | (F.col("requested") == F.col("arxiv_id"))) & F.col("arxiv_id").rlike(fixed.ARXIV_VERSION)
    r = checked(r, same & (F.size("cells") == 1), "page is not of", "requested")
    found = F.regexp_extract_all(F.col("cells")[0], F.lit(fixed.CATEGORY))
    return r.select("requested", "arxiv_id", "title", "abstract", "doi", F.array_distinct(found).alias("categories"))


def entry_id(address: Column) -> Column:
    """The paper's identifier at the end of a feed entry's address; null for anything else."""
    return text.arxiv_id(F.regexp_replace(address, r"^http://", "https://"))


def identity_error(ident: Column, requested: Column) -> Column:
    """Why what a source gave is not what it was asked for, or null: no identifier, another paper, or not the version asked for."""
    base = lambda c: F.regexp_replace(c, fixed.ARXIV_VERSION, "")
    return F.when(ident.isNull(), "no identifier").when(base(ident) != base(requested), "another paper").when(requested.rlike(fixed.ARXIV_VERSION) & (ident != requested), "another version")


def in_scope(categories: Column, aliases: list[str]) -> Column:
    """Whether a record has a mathematics category, by shape or alias."""
    return F.exists(categories, lambda c: c.rlike(fixed.MATHEMATICS) | c.isin(aliases))


def displayed_abstract(papers: DataFrame) -> DataFrame:
    """papers (paper_id, title, doi, body, layout) with `found`: the abstract that a publisher page shows for the
    paper, "" if it shows another. A page of layout "titled" must carry the paper's title, one of layout
    "identified" its DOI, if the paper has one."""
    at = lambda pattern: F.regexp_extract("body", pattern, 1)
    shown_title = at(fixed.SHOWN_TITLE)
    titled = at(fixed.SHOWN_ABSTRACT)
    same = text.title_key(text.clean_text(shown_title)) == text.title_key(text.clean_text("title"))
    dois = F.transform(F.regexp_extract_all("body", F.lit(fixed.PAPER_DOI)), text.doi_key)
    english = at(fixed.ENGLISH_ABSTRACT)
    identified = F.when(english != "", english).otherwise(at(fixed.ARTICLE_ABSTRACT))
    named = (F.coalesce("doi", F.lit("")) == "") | F.array_contains(dois, F.col("doi"))
    raw = F.when((F.col("layout") == "titled") & (shown_title != "") & same, titled).when((F.col("layout") == "identified") & named, identified).otherwise("")
    return papers.withColumn("found", text.clean_text(raw))


def import_error(title: Column, abstract: Column, doi: Column, categories: Column, aliases: list[str]) -> Column:
    """Why an imported record can't be used, or null."""
    return F.coalesce(
        F.when(F.coalesce(F.size(F.filter(categories, lambda c: c != "")), F.lit(0)) < 1, "no_categories"),
        F.when(~in_scope(categories, aliases), "out_of_scope"),
        F.when((F.coalesce(title, F.lit("")) == "") | (F.coalesce(abstract, F.lit("")) == ""), "no_text"),
        F.when((F.length(title) > 2000) | (F.length(abstract) > 30000) | (F.length(doi) > 300), "too_long"),
    )
