"""Pairs of similar texts without comparing all pairs: a set-similarity join with prefix and length filters, then the exact ratio.

Two texts of a and b characters whose matching blocks hold M of them have the ratio 2 M / (a + b). At a ratio of r or more, one can be
made from the other by d <= (1 - r)(a + b) insertions and deletions. Each destroys at most q of the text's q-grams, so
the longer text keeps at least max(a, b) - q + 1 - q d of its grams, counted with repeats, in the other. So

* lengths differ by a factor of (2 - r) / r at most, and
* with all grams in one order, rare ones first, the two texts share a gram among their first n - t + 1, where n is a text's number
  of grams and t the least overlap that it can have with any text of fitting length.

Texts too short for any gram to be sure (t < 1) share an entry of their own, by length. What passes is compared exactly.

Where columns must be equal, most groups of equal values are small, and grams would be many times the texts. There, texts meet by these
columns alone, and a pair is looked at further only if its lengths fit and its counts of characters allow M. Grams are made only
of the texts of larger groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from winnow.shared import kept

#: Longer grams tell texts apart better, but more of them must be looked at.
Q = 3
#: Pairs, and texts, in a group of equal columns up to which they are looked at one by one.
GROUP, TEXTS = 1 << 20, 1 << 14
#: Pairs that are looked at and that are compared at once, and the length from which difflib leaves frequent characters out.
LOOK, PAIRS, LONG = 1 << 17, 4096, 200


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts as numbers, and where each text starts among them."""
    texts = texts.cast(pa.string())
    whole = "".join(texts.to_pylist())
    data = np.frombuffer(whole.encode(), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    return data, np.concatenate([[0], np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _counts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each text has characters of 16 kinds, as so many bits of eight for each; and the number beyond eight."""
    texts = len(starts) - 1
    n = np.bincount(np.repeat(np.arange(texts) * 16, np.diff(starts)) + (data & 15), minlength=16 * texts).reshape(-1, 16)
    return ((1 << np.minimum(n, 8)) - 1).astype(np.uint8).view(np.uint64), np.maximum(n - 8, 0).sum(axis=1)


def matched(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The characters in matching blocks of each pair of texts of less than LONG characters, as difflib has them: the longest block, of
    those the first in a and in b, and the same left and right of it. All pairs go through the steps together."""
    (x, x0), (y, y0) = _characters(a), _characters(b)
    place = lambda data, starts: data[np.minimum(starts[:-1] + np.arange(max(1, np.diff(starts).max(initial=0)))[:, None], len(data) - 1)]
    total = np.zeros(len(a), np.int64)
    part = np.flatnonzero((np.diff(x0) > 0) & (np.diff(y0) > 0))
    if not len(part):
        return total
    x, y = place(x, x0), place(y, y0)  # a column a text
    alo, ahi, blo, bhi = (v[part].astype(np.int16) for v in (np.zeros(len(a)), np.diff(x0), np.zeros(len(a)), np.diff(y0)))
    while len(part):
        own, other = x[:, part], y[:, part]
        at = np.arange(len(other))[:, None]
        inside = (at >= blo) & (at < bhi)
        run, best, i_end, j_end = np.zeros((len(other), len(part)), np.uint8), np.zeros(len(part), np.uint8), alo.copy(), blo.copy()
        for i in range(int(alo.min()), int(ahi.max())):
            same = (other == own[i]) & inside
            same &= (i >= alo) & (i < ahi)
            run[1:] = run[:-1] + 1
            run[0] = 1
            run *= same
            most = run.max(axis=0)
            if len(better := np.flatnonzero(most > best)):
                best[better], i_end[better], j_end[better] = most[better], i + 1, run[:, better].argmax(axis=0) + 1
        np.add.at(total, part, best)
        i, j = i_end - best, j_end - best
        sides = [(part, alo, i, blo, j), (part, i_end, ahi, j_end, bhi)]
        some = [(best > 0) & (s[1] < s[2]) & (s[3] < s[4]) for s in sides]
        part, alo, ahi, blo, bhi = (np.concatenate([s[k][m] for s, m in zip(sides, some, strict=True)]) for k in range(5))
    return total


def _ratios(a: pa.Array, b: pa.Array) -> np.ndarray:
    n, m = (pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b))
    blocks, short = np.zeros(len(n)), np.maximum(n, m) < LONG
    blocks[short] = matched(a.filter(pa.array(short)), b.filter(pa.array(short)))
    for k in np.flatnonzero(~short):
        blocks[k] = sum(s.size for s in SequenceMatcher(None, a[k].as_py(), b[k].as_py()).get_matching_blocks())
    return np.where(n + m > 0, 2.0 * blocks / np.maximum(n + m, 1), 1.0)


def _looked_at(sides: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right): the pairs of rows of one group and different sides, LOOK or so at a time. Rows come by group and side."""
    one = sides == 1
    rights = np.bincount(groups, one, groups[-1] + 1).astype(np.int64)
    lefts = np.flatnonzero(~one)
    first = np.searchsorted(groups, np.arange(len(rights)), side="right") - rights
    many = rights[groups[lefts]]
    ends = np.cumsum(many)
    at = 0
    while at < len(lefts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOK, side="right")))
        some, n = lefts[at:to], many[at:to]
        yield np.repeat(some, n), np.repeat(first[groups[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at = to


#: A text on its way: its bytes after a 0; if it is all hexadecimal digits, the bytes they name after a 1, or a 2 where a zero leads.
_PACKED = r"""CASE WHEN NOT text RLIKE '^[0-9a-f]+\\z' THEN concat(X'00', cast(text AS binary)) WHEN length(text) % 2 = 0 THEN concat(X'01', unhex(text)) ELSE concat(X'02', unhex(concat('0', text))) END"""
_UNPACKED = """CASE substring(packed, 1, 1) WHEN X'00' THEN cast(substring(packed, 2) AS string) WHEN X'01' THEN lower(hex(substring(packed, 2))) ELSE lower(substring(hex(substring(packed, 2)), 2)) END"""


def _within_groups(left: DataFrame, right: DataFrame, ratio: float, on: list[str]) -> DataFrame:
    """The similar pairs of texts with equal `on`, each pair looked at: for groups of bounded size. The texts are shuffled, once, and
    nothing else is."""
    side = lambda df, k: df.select(*on, F.lit(k).alias("side"), "id", F.expr(_PACKED).alias("packed"))
    dealt = side(left, 0).unionByName(side(right, 1)).repartition(*on).sortWithinPartitions(*on, "side").select(*on, "side", "id", F.expr(_UNPACKED).alias("text"))
    k, reach = len(on), (2 - ratio) / ratio
    names = ["left_id", "right_id", *on, "similarity"]

    def begins(t: pa.Table) -> np.ndarray:
        """The rows with which a group begins."""
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for c in t.columns[:k]:
            differ = pc.not_equal(c[1:], c[:-1])
            if pa.types.is_floating(c.type):
                differ = pc.and_not(differ, pc.and_(pc.is_nan(c[1:]), pc.is_nan(c[:-1])))
            new |= differ.to_numpy()
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        texts = t.column(k + 2).chunk(0)
        data, starts = _characters(texts)
        n, (bits, over) = np.diff(starts), _counts(data, starts)
        new = np.zeros(t.num_rows, np.int64)
        new[begins(t)[1:]] = 1
        for a, b in _looked_at(t.column(k).to_numpy(), np.cumsum(new)):
            fit = np.maximum(n[a], n[b]) <= np.minimum(n[a], n[b]) * reach + 1e-9
            common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(over[a], over[b])
            fit = np.flatnonzero(fit & (2 * common >= ratio * (n[a] + n[b]) - 1e-9))
            for at in range(0, len(fit), PAIRS):
                x, y = a[fit[at : at + PAIRS]], b[fit[at : at + PAIRS]]
                found = _ratios(texts.take(pa.array(x)), texts.take(pa.array(y)))
                good = found >= ratio
                x, y = pa.array(x[good]), pa.array(y[good])
                of = lambda c, i: c.chunk(0).take(i)
                yield pa.RecordBatch.from_arrays([of(t.column(k + 1), x), of(t.column(k + 1), y), *(of(c, x) for c in t.columns[:k]), pa.array(found[good])], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # the last group may go on
        for b in batches:
            t = pa.Table.from_batches([*held, b])
            last = int(begins(t)[-1]) if t.num_rows else 0
            if last:
                yield from pairs(t.slice(0, last))
            held = t.slice(last).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    columns = [("left_id", kinds["id"]), ("right_id", kinds["id"]), *((c, kinds[c]) for c in on), ("similarity", "double")]
    return dealt.mapInArrow(each, ", ".join(f"`{c}` {t}" for c, t in columns))


def _grams(c: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(c) - (Q - 1))
    return F.when(F.length(c) >= Q, F.transform(places, lambda i: F.substring(c, i, F.lit(Q)))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    a, b = pa.array(a, pa.string()), pa.array(b, pa.string())
    return pd.Series(np.concatenate([np.zeros(0), *(_ratios(a[at : at + PAIRS], b[at : at + PAIRS]) for at in range(0, len(a), PAIRS))]))


def similar_pairs(left: DataFrame, right: DataFrame, ratio: float = 0.9, on: list[str] | None = None, group: int = GROUP) -> DataFrame:
    """(left_id, right_id, similarity) of the texts (id, text, and the columns `on`, which must be equal) of both sides whose ratio of
    matching blocks is at least `ratio`. Null texts are in no pair; two empty ones are equal. Ids name texts."""
    on = on or []
    if not on:
        return _by_grams(left, right, ratio, on)
    some = lambda df: df.where("text IS NOT NULL").dropna(subset=on).select("id", "text", *on)
    left, right = some(left), some(right)
    sizes = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    large = kept(sizes.groupBy(*on).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).where((F.col("_l") * F.col("_r") > group) | (F.col("_l") + F.col("_r") > TEXTS)).select(*on), "large")
    if large.isEmpty():
        return _within_groups(left, right, ratio, on)
    small = _within_groups(left.join(large, on, "left_anti"), right.join(large, on, "left_anti"), ratio, on)
    return small.unionByName(_by_grams(left.join(large, on, "left_semi"), right.join(large, on, "left_semi"), ratio, on))


def _by_grams(left: DataFrame, right: DataFrame, ratio: float, on: list[str]) -> DataFrame:
    """The similar pairs of texts with equal `on`, met by their rare grams or, short ones, by length."""
    side = lambda df, name: df.where("text IS NOT NULL").select(F.lit(name).alias("side"), F.col("id"), "text", *on)
    texts = kept(side(left, 0).unionByName(side(right, 1)), "texts")
    grams = texts.select("side", "id", *on, F.length("text").alias("n"), F.posexplode(_grams(F.col("text"))).alias("at", "gram"))
    nth = F.row_number().over(Window.partitionBy("side", "id", *on, "gram").orderBy("at"))  # a set stands for the bag
    grams = kept(grams.select("side", "id", *on, "n", F.concat_ws("\0", "gram", nth).alias("gram")), "grams")
    seen = grams.groupBy("gram").agg(F.count("*").alias("seen"))
    # the least overlap of a text of n characters: as a function of the partner's length it is least at the same length
    sure = lambda n: F.ceil(n - (Q - 1) - Q * 2 * (1 - ratio) * n - 1e-9)
    place = F.row_number().over(Window.partitionBy("side", "id", *on).orderBy("seen", "gram"))
    first = grams.join(seen, "gram").withColumn("place", place).where(F.col("place") <= F.col("n") - (Q - 1) - F.greatest(sure(F.col("n")), F.lit(1)) + 1)
    keyed = first.where(sure(F.col("n")) >= 1).select("side", "id", *on, "n", F.concat(F.lit("g"), "gram").alias("key"))
    # short texts meet by length alone: those of a length, and of the lengths that fit it
    reach = (2 - ratio) / ratio
    short = texts.withColumn("n", F.length("text")).where(sure(F.col("n")) < 1)
    longest = short.agg(F.max("n")).first()[0]
    if longest is not None:
        by_length = lambda rows, s: rows.where(F.col("side") == s).select("side", "id", *on, "n")
        near = texts.withColumn("n", F.length("text")).where(F.col("n") <= math.floor(longest * reach + 1e-9))
        spread = F.sequence(F.ceil(F.col("n") / reach - 1e-9).cast("int"), F.floor(F.col("n") * reach + 1e-9).cast("int"))
        own = by_length(near, 0).withColumn("key", F.concat(F.lit("n"), F.col("n")))
        others = by_length(near, 1).withColumn("key", F.explode(F.transform(spread, lambda x: F.concat(F.lit("n"), x))))
        keyed = keyed.unionByName(own).unionByName(others)
    a = keyed.where("side = 0").select(F.col("id").alias("left_id"), *on, F.col("n").alias("m"), "key")
    b = keyed.where("side = 1").select(F.col("id").alias("right_id"), *on, "n", "key")
    fits = F.greatest("m", "n") <= F.least("m", "n") * reach + 1e-9
    met = a.join(b, [*on, "key"]).where(fits).select("left_id", "right_id", *on).distinct()
    of = lambda s, i, t: texts.where(F.col("side") == s).select(F.col("id").alias(i), *on, F.col("text").alias(t))
    both = met.join(of(0, "left_id", "a"), ["left_id", *on]).join(of(1, "right_id", "b"), ["right_id", *on])
    return both.withColumn("similarity", _ratio("a", "b")).where(F.col("similarity") >= ratio).select("left_id", "right_id", *on, "similarity")
