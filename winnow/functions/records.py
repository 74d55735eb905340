"""Functions over nested records: dates, inverted indices, digests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def publication_year(print_parts: Column, online_parts: Column, published_parts: Column, issued_parts: Column) -> Column:
    """struct(year, field): the first of the four date-parts arrays (of arrays of int) that has a year."""
    named = [("published-print", print_parts), ("published-online", online_parts), ("published", published_parts), ("issued", issued_parts)]
    year = lambda parts: F.get(F.get(parts, F.lit(0)), F.lit(0))
    return F.coalesce(*[F.when(year(p).isNotNull(), F.struct(year(p).alias("year"), F.lit(name).alias("field"))) for name, p in named])


def from_inverted_index(index: Column) -> Column:
    """The text of a map from words to positions; "" for an empty or null map, null if positions are
    negative, 100,000 or more, repeated, or leave a gap."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(pairs)
    whole = F.forall(F.zip_with(ordered, F.sequence(F.lit(0), F.size(ordered) - 1), lambda x, i: x["p"].eqNullSafe(i)), lambda ok: ok)
    text = F.array_join(F.transform(ordered, lambda x: x["w"]), " ")
    return F.when(index.isNull() | (F.size(index) == 0), "").when((F.size(ordered) > 0) & (F.size(ordered) <= 100_000) & whole, text)


def ordered_digest(record: Column) -> Column:
    """SHA-256 of a struct as compact JSON that keeps its field order and nulls."""
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def digest_of(value) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


@F.pandas_udf(StringType())
def pair_list_digest(keys: pd.Series) -> pd.Series:
    """SHA-256 of a list of (kind, value) structs as sorted-key JSON with spaced separators."""
    return keys.map(lambda ks: digest_of([[k["kind"], k["value"]] for k in ks]))
