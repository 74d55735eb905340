"""Scans that come in pages: which pages belong to a scan, why it ended, and whether it is whole.

A page is a row (scan, page, status, cursor, next_cursor, items, reported): its number in the scan, the cursor it was
asked with, the one it gave, how many items it holds and how many the source says there are. The rules are
columns over saved pages; whoever fetches asks `followed` for the last page and goes on where `stop` is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.sources.publishers import checked


def followed(pages: DataFrame, page_size: int | None = None, cap: int | None = None) -> DataFrame:
    """The pages that a scan reaches, with `stop`: why it ends there, or null where it goes on.

    `unavailable`: no status, or an error; `cap`: as many items as wanted; `empty`: no items; `last`: fewer than
    page_size items, if that is given; `no_cursor`, `repeated_cursor`: nowhere to go on from. Pages after a stop are left out.
    """
    first = pages.groupBy("scan", F.col("cursor").alias("next_cursor")).agg(F.min("page").alias("_used"))
    p = pages.join(first, ["scan", "next_cursor"], "left").select(*[pages[c] for c in pages.columns], "_used")
    sofar = F.sum("items").over(Window.partitionBy("scan").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    never = F.lit(False)
    rules = [
        ("unavailable", F.col("status").isNull() | (F.col("status") >= 400)),
        ("cap", sofar >= cap if cap is not None else never),
        ("empty", F.col("items") == 0),
        ("last", F.col("items") < page_size if page_size is not None else never),
        ("no_cursor", F.coalesce("next_cursor", F.lit("")) == ""),
        ("repeated_cursor", F.col("_used") <= F.col("page")),
    ]
    marked = p.withColumn("stop", F.coalesce(*[F.when(rule, why) for why, rule in rules]))
    end = F.min(F.when(F.col("stop").isNotNull(), F.col("page"))).over(Window.partitionBy("scan"))
    return marked.withColumn("_end", end).where("_end IS NULL OR page <= _end").drop("_used", "_end")


def scan_report(reached: DataFrame) -> DataFrame:
    """(scan, pages, retrieved, reported, stop, complete, error) of followed pages. A scan is complete when it came to its last page
    with as many items as its first page reported; the count of a scan that did not is not zero but unknown."""
    ok = F.col("status").isNotNull() & (F.col("status") < 400)
    r = reached.groupBy("scan").agg(
        F.count_if(ok).alias("pages"), F.coalesce(F.sum(F.when(ok, F.col("items"))), F.lit(0)).alias("retrieved"), F.min_by(F.when(ok, F.col("reported")), F.when(ok, F.col("page"))).alias("reported"), F.max("stop").alias("stop")
    )
    whole = F.coalesce(F.col("retrieved") >= F.col("reported"), F.lit(False))
    error = F.when(F.col("stop") == "unavailable", "unavailable").when(F.coalesce("stop", F.lit("")).isin("", "no_cursor", "repeated_cursor"), "Pagination ended prematurely").when(~whole, "Fewer records than reported total")
    return r.withColumns({"complete": error.isNull() & F.col("stop").isin("last", "empty"), "error": error})


def whole_scans(report: DataFrame) -> DataFrame:
    """report; reading it fails where a scan did not give exactly as many records as were reported."""
    return checked(report, F.col("retrieved") == F.col("reported"), "records and total differ in", "scan")


def asked(scans: DataFrame) -> DataFrame:
    """Scans (source, place, status), the filters of a source in turn, without those after one that was not found."""
    lost = F.max((F.col("status") == 404).cast("int")).over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return scans.withColumn("_lost", lost).where("coalesce(_lost, 0) = 0").drop("_lost")


def catalog_scan(pages: DataFrame, most: int = 100) -> DataFrame:
    """(group, page, links, complete) of the saved pages (group, page, links array) of a catalog that is read until a page has
    none: complete says that the empty page was met, within `most` pages. A link on two pages of a group is an error."""
    end = F.min(F.when(F.size("links") == 0, F.col("page"))).over(Window.partitionBy("group"))
    kept = pages.withColumn("_end", end).where("_end IS NULL OR page < _end").withColumn("complete", F.coalesce(F.col("_end") <= most, F.lit(False)))
    places = kept.select("group", F.explode(F.array_distinct("links")).alias("_link")).groupBy("group", "_link").count()
    twice = places.groupBy("group").agg(F.max("count").alias("_most"), F.max_by("_link", "count").alias("_link"))
    both = kept.join(twice, "group", "left")
    return checked(both, F.coalesce(F.col("_most"), F.lit(0)) <= 1, "a link on two pages:", "_link").select("group", "page", "links", "complete")
