"""Joins with conditions on how many rows match, source precedence, and set comparisons that must hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_match(left: DataFrame, right: DataFrame, on: Sequence[str], id_col: str, accept: Column | None = None) -> DataFrame:
    """left with the columns of the one row of right that matches (and passes accept); rows with none or several are left out."""
    joined = left.join(right, list(on))
    joined = joined.where(accept) if accept is not None else joined
    counted = joined.withColumn("_n", F.count("*").over(Window.partitionBy(id_col)))
    return counted.where("_n = 1").drop("_n")


def waterfall(base: DataFrame, id_col: str, sources: Sequence[tuple[str, DataFrame]], usable) -> DataFrame:
    """(id, text, source): the first usable text of the sources in turn. Each source, (id, text), meets only rows that still lack one."""
    left, parts = base.select(id_col).distinct(), []
    for name, source in sources:
        found = left.join(source.select(id_col, "text").where(usable(F.col("text"))), id_col)
        found = found.groupBy(id_col).agg(F.min("text").alias("text")).withColumn("source", F.lit(name))
        parts.append(found)
        left = left.join(found, id_col, "left_anti")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(left.select(id_col, F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source")))


def prefer(first: DataFrame, second: DataFrame, key: str, use_first: Column) -> DataFrame:
    """(key, origin, value): first's row where use_first (over first.value) holds, else second's, else pending."""
    a = first.select(key, F.col("value").alias("_a"), F.coalesce(use_first, F.lit(False)).alias("_use"))
    b = second.select(key, F.col("value").alias("_b"), F.lit(True).alias("_there"))
    both = a.join(b, key, "full_outer")
    origin = F.when(F.col("_use"), "first").when(F.col("_there"), "second").otherwise("pending")
    return both.select(key, origin.alias("origin"), F.when(origin == "first", F.col("_a")).when(origin == "second", F.col("_b")).alias("value"))


def without_shared_keys(df: DataFrame, keys: str, excluded: DataFrame, id_col: str) -> DataFrame:
    """df without the rows any of whose keys is listed in excluded.key."""
    hit = df.select(id_col, F.explode(keys).alias("key")).join(excluded.select("key").distinct(), "key", "left_semi").select(id_col).distinct()
    return df.join(hit, id_col, "left_anti")


def missing(required: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of required that present lacks; a superset check holds when there are none."""
    return required.select(*on).distinct().join(present.select(*on).distinct(), list(on), "left_anti")


def require_empty(violations: DataFrame, what: str) -> None:
    if rows := violations.limit(5).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in rows]}")


def differing_keys(a: DataFrame, b: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Keys that one side lacks, or whose rows differ in a column of `same`; none when two runs are comparable."""
    l = a.select(key, F.struct(*same).alias("_l"), F.lit(1).alias("_a"))
    r = b.select(key, F.struct(*same).alias("_r"), F.lit(1).alias("_b"))
    return l.join(r, key, "full_outer").where("_a IS NULL OR _b IS NULL OR NOT (_l <=> _r)").select(key)


def common_values(df: DataFrame, group: str, values: str) -> DataFrame:
    """(group, common): the values that all of a group's arrays hold, in order."""
    each = df.select(group, F.explode(F.array_distinct(values)).alias("v"))
    size = df.groupBy(group).agg(F.count("*").alias("_rows"))
    full = each.groupBy(group, "v").count().join(size, group).where("count = _rows")
    found = full.groupBy(group).agg(F.array_sort(F.collect_list("v")).alias("common"))
    empty = F.array().cast(found.schema["common"].dataType)
    return size.join(found, group, "left").select(group, F.coalesce("common", empty).alias("common"))


def match_log(left: DataFrame, right: DataFrame, on: Sequence[str], id_col: str, accept: Column | None = None) -> DataFrame:
    """(id, found, accepted, outcome) of every row of left: `matched` by one row of right that passes accept, `none` where no row
    has its keys, `mismatch` where none of those passes, `ambiguous` where several do. unique_match keeps the first kind."""
    there = right.withColumn("_there", F.lit(True))
    joined = left.join(there, list(on), "left")
    passed = F.coalesce(F.col("_there"), F.lit(False)) & (F.coalesce(accept, F.lit(False)) if accept is not None else F.lit(True))
    n = joined.groupBy(id_col).agg(F.count("_there").alias("found"), F.count_if(passed).alias("accepted"))
    outcome = F.when(F.col("found") == 0, "none").when(F.col("accepted") == 0, "mismatch").when(F.col("accepted") == 1, "matched").otherwise("ambiguous")
    return n.withColumn("outcome", outcome)
