"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed byte 3- to 6-grams of its lower-cased, space-collapsed whole text, as
present or absent. The log-ratio of each feature's smoothed share among toxic and other labelled texts
scales it; the `keep` features (8,192 unless given) that pull most, on `least` sampled texts (5) or more,
enter a logistic regression. The classifier is fitted on a bounded sample of labelled rows: `sample` rows
(20,000 unless given), those with the least hash of their id (ties: the least id) among rows outside the
held-out fold, so the model does not depend on how rows are dealt; every row of documents is scored, whole.

Null and empty texts have no features and score the model's intercept. Labels that are null are not used;
a document labelled twice counts as toxic if either label says so; of an id with several texts the least text
is learned from. Without labels of both kinds every
score is the share of toxic labels, or 0. Of features that pull equally the one with the lower number is kept first. Texts
of any length are scored whole, a megabyte of n-grams at a time. Repeated rows are each returned, with equal scores, and
so are rows whose id is null. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import held_out, materialize, modest_batches, text_of, tidy

BITS = 20
ORDERS = (3, 4, 5, 6)
_GAP = re.compile(r"\s+")
_STEP = 1 << 20


def grams(text: str, weights: np.ndarray | None = None) -> np.ndarray:
    """The distinct feature numbers of a text; only those of nonzero weight, if weights are given."""
    raw = np.frombuffer(f" {_GAP.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    found = []
    for at in range(0, len(raw), _STEP):
        b = raw[at : at + _STEP + max(ORDERS) - 1].astype(np.uint32)
        h, n = np.zeros(len(b), dtype=np.uint32), len(b)
        for k in range(max(ORDERS)):
            if n - k <= 0:
                break
            h = h[: n - k] * np.uint32(0x01000193) ^ b[k:]
            if k + 1 in ORDERS:
                f = (h * np.uint32(0x9E3779B1) + np.uint32(k)) >> np.uint32(32 - BITS)
                if weights is not None:
                    f = f[weights[f] != 0]
                found.append(f)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def sample_of(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, text) of at most `sample` labelled rows outside the held-out fold."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    one = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    few = one.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # the bound that makes it fit to be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    return materialize(texts.join(F.broadcast(few), "_id").groupBy("_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text"), "labelled")


def fit(rows: DataFrame, keep: int = 1 << 13, smooth: float = 1.0, l2: float = 3e-4, least: int = 5, steps: int = 200) -> tuple[np.ndarray, float]:
    """(weight of each feature, intercept) from (label, text) rows, whose number is bounded by the caller."""
    spark = rows.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), dtype=np.int32)
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total[label][grams(text.as_py())] += 1
        # the features met, in blocks of 4096 numbers: their places in the block, and their counts
        met = np.flatnonzero(total.reshape(-1))
        blocks, first = np.unique(met >> 12, return_index=True)
        parts = [(m & 4095).astype("<u2").tobytes() for m in np.split(met, first[1:])], [total.reshape(-1)[m].tobytes() for m in np.split(met, first[1:])]
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *(pa.array(x, pa.binary()) for x in parts)], ["block", "places", "counts"])

    def add(key: tuple, t: pa.Table) -> pa.Table:
        total = np.zeros(4096, dtype=np.int64)
        for places, counts in zip(t.column("places"), t.column("counts"), strict=True):
            total[np.frombuffer(places.as_py(), dtype="<u2")] += np.frombuffer(counts.as_py(), dtype=np.int32)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([total.astype("<i4").tobytes()], pa.binary())})

    parts = rows.mapInArrow(tidy(count), "block long, places binary, counts binary").groupBy("block").applyInArrow(add, "block long, counts binary")
    counts = np.zeros((2, 1 << BITS), dtype=np.int32)
    for r in parts.toLocalIterator():  # the size of the feature space, whatever the corpus
        counts.reshape(-1)[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(bytes(r["counts"]), dtype="<i4")
    n_by = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n_neg, n_pos = n_by.get(0, 0), n_by.get(1, 0)
    weights = np.zeros(1 << BITS, dtype=np.float32)
    if not n_neg or not n_pos:
        share = min(max(n_pos / max(1, n_neg + n_pos), 1e-6), 1 - 1e-6) if n_neg + n_pos else 1e-6
        return weights, float(np.log(share / (1 - share)))
    ratio = np.log((counts[1] + smooth) / (n_pos + 2 * smooth)) - np.log((counts[0] + smooth) / (n_neg + 2 * smooth))
    # a feature's pull is its ratio times its standard deviation among all rows
    share = (counts[0] + counts[1]) / (n_neg + n_pos)
    pull = np.abs(ratio) * np.sqrt(share * (1 - share))
    pull[counts.sum(axis=0) < least] = 0
    chosen = np.sort(np.argsort(-pull, kind="stable")[:keep])
    chosen = chosen[pull[chosen] > 0]
    number = np.full(1 << BITS, -1, dtype=np.int32)
    number[chosen] = np.arange(len(chosen))
    wanted = spark.sparkContext.broadcast(number >= 0)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([grams(t.as_py(), wanted.value).astype("<u4").tobytes() for t in b.column(1)], pa.binary())], ["label", "features"])

    labels, lists = [], []
    for r in rows.mapInArrow(tidy(pick), "label int, features binary").toLocalIterator():
        labels.append(r["label"])
        lists.append(number[np.frombuffer(bytes(r["features"]), dtype="<u4")])
    y, size = np.array(labels, dtype=np.float64), np.array([len(x) for x in lists])
    row, col = np.repeat(np.arange(len(y)), size), np.concatenate(lists)
    scale = ratio[chosen]
    value = scale[col]
    w, bias = np.zeros(len(chosen)), float(np.log(n_pos / n_neg))
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(row, value * w[col], len(y)) + bias
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.append(np.bincount(col, value * err[row], len(chosen)) + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    weights[chosen] = w * scale
    return weights, float(bias)


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score of each row's whole text. The model's size is fixed, so it is broadcast."""
    given, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = given.value
        for b in batches:
            z = np.array([float(weights[grams(t, weights)].astype(np.float64).sum()) if (t := b.column(at)[i].as_py()) else 0.0 for i in range(b.num_rows)]) + bias
            yield b.append_column(score_col, pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))))

    return modest_batches(docs).mapInArrow(tidy(each), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{score_col}` double")


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    return fit(sample_of(docs, labels, sample, id_col, text_col, label_col))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    model = train(docs, labels, sample)
    scored = with_score(docs.select("doc_id", text_of().alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
