"""A log of requests to the web service, judged row by row: the status each gets, and what an error may say outside.

The service itself is no part of the engine. Its guards are a cascade in a fixed order: the first that fails answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions import fixed, text

#: Guards in order: (status, name).
GUARDS = [
    (503, "starting"), (503, "not_configured"), (403, "host"), (404, "not_found"), (200, "page"), (405, "method"), (404, "not_found"),
    (403, "origin"), (415, "content_type"), (413, "size"), (403, "client"), (429, "budget"), (503, "busy"),
]


def _failing(readable: Column) -> list[Column]:
    """Of each guard, whether a request is answered by it."""
    path, site = F.col("path"), F.col("site")
    reads = F.coalesce(F.col("method").isin("GET", "HEAD"), F.lit(False))
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    n = F.coalesce(F.trim(F.col("content_length")).try_cast("long"), F.lit(0))
    most = F.when(path == fixed.IMPORT_PATH, fixed.IMPORT_BYTES).otherwise(fixed.SUGGEST_BYTES)
    encoded = F.coalesce("transfer_encoding", F.lit("")) != ""
    return [
        site.isNull(),
        ~site.rlike(fixed.SITE),
        ~F.col("host").eqNullSafe(site),
        reads & ~readable,
        reads,
        ~F.col("method").eqNullSafe("POST"),
        ~F.coalesce(path.isin(fixed.SUGGEST_PATH, fixed.IMPORT_PATH), F.lit(False)),
        ~F.col("origin").eqNullSafe(F.concat(F.lit("https://"), site)) | (F.coalesce("fetch_site", F.lit("same-origin")) != "same-origin"),
        kind != "application/json",
        encoded | (n <= 0) | (n > most),
        text.client_key(F.coalesce("client", F.lit(""))).isNull(),
        ~F.coalesce("allowed", F.lit(False)),
        F.coalesce("busy", F.lit(False)),
    ]


def judged(log: DataFrame, pages: list[str]) -> DataFrame:
    """log (site, host, method, path, origin, fetch_site, content_type, content_length, transfer_encoding, client, allowed, busy and
    others; pages are the paths that can be read) with `status` and `guard`: 200 and null where the request goes on to the service."""
    readable = F.coalesce(F.col("path").isin(*pages), F.lit(False)) if pages else F.lit(False)
    first = F.coalesce(*[F.when(bad, F.struct(F.lit(code).alias("status"), F.lit(name).alias("guard"))) for (code, name), bad in zip(GUARDS, _failing(readable), strict=True)])
    found = log.withColumn("_first", first)
    return found.select(*log.columns, F.coalesce("_first.status", F.lit(200)).alias("status"), F.col("_first.guard").alias("guard"))


def crossing_code(failure: Column) -> Column:
    """What of a failure of the import crosses to the outside: a fixed code, or null where it must not be told."""
    return F.when(failure == "scope", fixed.OUT_OF_SCOPE).when(failure == "unavailable", fixed.UNAVAILABLE)


def answer_status(path: Column, code: Column, failure: Column) -> Column:
    """The status of an answer: its error code (null: none), or the kind of failure that kept it from coming (null: none)."""
    imported = path == fixed.IMPORT_PATH
    return (
        F.when(failure == "invalid", 400).when(failure == "unavailable", 503).when(failure.isNotNull(), 500)
        .when(imported & (code == fixed.OUT_OF_SCOPE), 400).when(F.coalesce(code, F.lit("")) != "", 503).otherwise(200)
    )
