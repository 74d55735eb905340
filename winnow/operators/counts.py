"""Counts that keep unknown apart from zero, and the resolution of metadata variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_year(df: DataFrame, group: str, year: str, years: Sequence[int]) -> DataFrame:
    """(group, total, one column for each year), years without rows as 0."""
    columns = [F.count_if(F.col(year) == y).alias(str(y)) for y in years]
    return df.groupBy(group).agg(F.count("*").alias("total"), *columns)


def known_count(status: Column, n: Column) -> Column:
    """The count where coverage is complete (no rows: 0), else null."""
    return F.when(status == "complete", F.coalesce(n, F.lit(0)))


def completeness(sources: DataFrame, group: str, complete: str, series: Sequence[str] = ()) -> DataFrame:
    """(group, scan_complete, status): complete if there is a source and all of them are."""
    done = sources.groupBy(group).agg((F.count(complete) > 0).alias("_any"), F.coalesce(F.bool_and(complete), F.lit(False)).alias("_all"))
    whole = F.col("_any") & F.col("_all")
    status = F.when(F.col(group).isin(*series), "needs_series_review").when(whole, "complete").otherwise("incomplete")
    return done.select(group, whole.alias("scan_complete"), status.alias("status"))


def resolve_variants(df: DataFrame, key: str, variant: Column, signature: Column, reason: Column, ordinal: Column) -> DataFrame:
    """Per key, over its distinct variants: outcome is accepted, conflicting_metadata_versions (several signatures
    among the good, or good beside bad) or the first variant's reason; first_good is the ordinal of the first good one."""
    rows = df.select(key, variant.alias("v"), signature.alias("s"), reason.alias("r"), ordinal.alias("o"))
    first = rows.groupBy(key, "v").agg(F.min_by(F.struct("s", "r"), "o").alias("x"), F.min("o").alias("o"))
    good = F.col("x.r").isNull()
    agg = first.groupBy(key).agg(
        F.count_distinct(F.when(good, F.col("x.s"))).alias("signatures"),
        F.count_if(good).alias("good"),
        F.count("*").alias("variants"),
        F.min_by("x.r", "o").alias("first_reason"),
        F.min(F.when(good, F.col("o"))).alias("first_good"),
    )
    mixed = (F.col("signatures") > 1) | ((F.col("good") > 0) & (F.col("good") < F.col("variants")))
    outcome = F.when(mixed, "conflicting_metadata_versions").when(F.col("good") > 0, "accepted").otherwise(F.col("first_reason"))
    return agg.select(key, outcome.alias("outcome"), "variants", F.when(outcome == "accepted", F.col("first_good")).alias("first_good"))


def last_write(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Of the rows of a key, that with the greatest ordinal."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), ordinal).alias("_last")).select(key, "_last.*")


def mean_after_first(df: DataFrame, order: str, seconds: str, per: int) -> DataFrame:
    """One row: seconds a record, over the steps after the first, which warms up; `per` records a step."""
    first = F.min_by(F.col(seconds), order)
    return df.agg(((F.sum(seconds) - first) / (F.count("*") - 1) / per).alias("seconds_per_record"))
