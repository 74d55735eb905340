"""Near-duplicate embeddings: binary codes by iterative quantisation, multi-index Hamming tables, exact cosines.

Codes. Unit vectors of a bounded sample are centred and projected on their main directions (up to 64). Several
rotations of those are learned, each alternating between the signs of the rotated sample and the orthogonal matrix
that brings the sample nearest to them; thresholds are medians, so each bit is set in half of the sample.

Tables. A code is cut into substrings of as many bits as a label's rows need to spread to about one a bucket,
and a vector lies in the bucket of each: two codes that differ in fewer bits than there are tables share one. How
many tables there are is calibrated: pairs made from the sample at exactly the threshold's angle (turned at random,
and towards other vectors) must share a bucket in all but `miss` of cases; if no affordable number does,
substrings get shorter.

Retrieval compares the first 128 bits of those that share a bucket by exclusive-or and bit counts, in blocks of
bounded size, and returns a spanning forest; the radius is six standard deviations above the calibration pairs.
What is joined by it is a candidate component. Its original vectors are compared there exactly, all pairs of blocks,
so that near vectors that shared no bucket themselves are found too. Tasks return counts and a spanning forest of
links, never the pairs. Rows that are equal in label and vector are one node with a count, so copies are no work.

Only equal labels that are not null are compared, and only vectors of equal length. Vectors that are null, zero, or
hold null or non-finite components, and rows without label, link with nothing: no links, component_id their own id.
Vectors of another length than most lie in one bucket for each label and length. Rows, not ids, are counted and linked,
so an id repeated links like any other; rows with a null id take part, and a component's id is its least non-null
one (null if it has none). No rows, no result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.ann import _matrix, _unit
from winnow.llm.common import materialize, modest_batches, tidy
from winnow.llm.simhash import _block_pairs, _dealt, _forest, candidate_links
from winnow.operators.components import connected_components

BITS = 64
#: So many rotations are learned at most.
ROTATIONS = 32
_ROUNDS = 30


def rotation(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix under which the rows of x (centred) are near to their signs."""
    turn = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(_ROUNDS):
        signs = np.where(x @ turn >= 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(x.T @ signs)
        turn = u @ vt
    return turn


def turned(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each row of x (units) a unit vector at this cosine: half in random directions, half towards other rows."""
    aim = rng.standard_normal(x.shape)
    half = len(x) // 2
    aim[:half] = x[rng.permutation(len(x))[:half]] + 1e-3 * aim[:half]
    aim -= (aim * x).sum(axis=1, keepdims=True) * x
    length = np.sqrt((aim * aim).sum(axis=1, keepdims=True))
    return cosine * x + np.sqrt(1 - cosine * cosine) * aim / np.maximum(length, 1e-300)


class Codes:
    """Rotations learned on a sample of unit vectors, and the substrings that name a code's buckets."""

    def __init__(self, sample: np.ndarray, cosine: float, group: int, miss: float = 5e-4, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        self.basis = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :BITS]
        self.bits = self.basis.shape[1]
        flat = centred @ self.basis
        pairs = sample[rng.permutation(len(sample))[:4096]]
        near = [((p - self.mean) @ self.basis) for p in (pairs, turned(pairs, cosine, rng))]
        self.turns: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        flips: list[np.ndarray] = []  # per rotation and calibration pair, which bits differ

        def learn() -> None:
            turn = rotation(flat, rng)
            cut = np.median(flat @ turn, axis=0)
            self.turns.append(turn)
            self.cuts.append(cut)
            flips.append((near[0] @ turn > cut) != (near[1] @ turn > cut))

        while len(self.turns) < 2:
            learn()
        for width in range(min(self.bits, max(4, int(np.ceil(np.log2(max(2, group)))))), 0, -1):
            each = self.bits // width
            met = lambda f: (~f[:, : each * width].reshape(len(f), each, width).any(axis=2))  # noqa: B023, E731
            rate = max(1e-9, np.mean([met(f).mean() for f in flips]))
            if width > 1 and np.log(miss) / np.log1p(-min(rate, 1 - 1e-9)) > each * ROTATIONS:
                continue
            used = 0
            missed = np.ones(len(pairs), dtype=bool)
            while missed.mean() > miss and used < ROTATIONS:
                if used == len(self.turns):
                    learn()
                missed &= ~met(flips[used]).any(axis=1)
                used += 1
            if missed.mean() <= miss or width == 1:
                break
        self.width, self.each, self.used, self.missed = width, each, max(1, used), float(missed.mean())
        apart = np.concatenate(flips[:2], axis=1)[:, :128].sum(axis=1)
        self.radius = int(np.ceil(apart.mean() + 6 * apart.std() + 1))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of code, as two words a row, and the numbers of its buckets, one a table."""
        flat = (_unit(x) - self.mean) @ self.basis
        bits = [flat @ turn > cut for turn, cut in zip(self.turns[: max(2, self.used)], self.cuts, strict=False)]
        first = np.concatenate(bits[:2], axis=1)[:, :128]
        words = np.packbits(np.pad(first, ((0, 0), (0, 128 - first.shape[1]))), axis=1, bitorder="little").view("<u8")
        powers = 1 << np.arange(self.width, dtype=np.int64)
        keys = [b[:, : self.each * self.width].reshape(len(b), self.each, self.width) @ powers for b in bits[: self.used]]
        return words, np.concatenate(keys, axis=1)


def _taking_part(label_col: str, vec_col: str, kind: str) -> tuple[Column, Column]:
    """The group (label and length) of a row, null if it links with nothing, and its vector."""
    v = F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(label_col).isNotNull()
    return F.when(ok, F.concat_ws(":", F.size(v), F.col(label_col).cast("string"))), v


def _cosines(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x and y reach the cosine in double precision."""
    close = _unit(x) @ _unit(y).T
    found = close >= cosine
    for i, j in zip(*np.nonzero(np.abs(close - cosine) < 1e-9), strict=True):  # the order of the sums could tell
        a, b = x[i] / np.abs(x[i]).max(), y[j] / np.abs(y[j]).max()
        found[i, j] = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) >= cosine
    return found


def exact_links(members: DataFrame, cosine: float, block_bytes: int = 1 << 20) -> DataFrame:
    """Between the members (tile, node, v, copies) of each tile: (a, b, n) spanning links, n null, and with b null the number n
    of rows that a block links with node a."""
    pairs = _block_pairs(*_dealt(members, "tile", 64 + 8 * F.size("v"), block_bytes), "tile", ["node", "v", "copies"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                same, blocks = b.column(2)[k].as_py(), [b.column(0)[k].values]
                if not same:
                    blocks.append(b.column(1)[k].values)
                vectors = [_matrix(x.field("v")) for x in blocks]
                names, copies = [[f(x.field(c)) for x in blocks] for c, f in (("node", lambda c: np.array(c.to_pylist(), dtype=object)), ("copies", lambda c: c.to_numpy()))]
                edges, sums = [], [np.zeros(len(x), np.int64) for x in names]
                step = max(1, (1 << 20) // max(1, len(names[-1])))
                for at in range(0, len(names[0]), step):
                    near = _cosines(vectors[0][at : at + step], vectors[-1], cosine)
                    if same:
                        near[np.arange(len(near)), at + np.arange(len(near))] = False
                    sums[0][at : at + step] += near @ copies[-1]
                    if not same:
                        sums[1] += near.T @ copies[0][at : at + step]
                    i, j = np.nonzero(near)
                    edges.append(_forest(names[0][at + i], names[-1][j]))
                left, right = _forest(*(np.concatenate(x) for x in zip(*edges, strict=True)))
                counted, n = np.concatenate(names), np.concatenate(sums)
                counted, n = counted[n > 0], n[n > 0]
                cols = [[*left, *counted], [*right, *[None] * len(n)], [*[None] * len(left), *n.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64()), strict=True)], ["a", "b", "n"])

    return pairs.mapInArrow(tidy(each), "a binary, b binary, n long")


def fit(nodes: DataFrame, cosine: float, sample: int, miss: float) -> tuple[Codes, int] | None:
    """Codes for the most frequent length of the nodes' vectors, and that length; the sample holds 2 ** 23 components at most."""
    dim = nodes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not dim:
        return None
    size = min(sample, max(1, (1 << 23) // dim["d"]))
    own = nodes.where(F.size("v") == dim["d"])
    picked = own.orderBy(F.xxhash64("node"), "node").limit(size).select("v").toArrow()
    group = own.groupBy("grp").count().agg(F.max("count")).first()[0]
    return Codes(_unit(_matrix(picked.column(0).combine_chunks())), cosine, group, miss), dim["d"]


def near_vectors(df: DataFrame, cosine: float = 0.98, sample: int = 16_384, miss: float = 5e-4, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept (vec_id = component_id)."""
    spark = df.sparkSession
    grp, v = _taking_part(label_col, vec_col, df.schema[vec_col].dataType.simpleString())
    rows = modest_batches(df).select(F.col(id_col).alias("vec_id"), grp.alias("grp"), v.alias("v"))
    words = [F.lpad(F.hex(F.xxhash64(F.lit(k), "grp", "v")), 16, "0") for k in (1, 2)]
    rows = rows.withColumn("node", F.when(F.col("grp").isNotNull(), F.unhex(F.concat(*words))))
    grouped = rows.where(F.col("grp").isNotNull()).groupBy("node")
    nodes = materialize(grouped.agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"), F.first("grp").alias("grp"), F.first("v").alias("v")), "nodes")
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")]
    fitted = fit(nodes, cosine, sample, miss)
    if fitted is None:
        return rows.select("vec_id", *alone)
    codes, dim = fitted
    given = spark.sparkContext.broadcast(codes)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fps, keys = given.value.of(_matrix(b.column(2)))
                signed = [pa.array(fps[:, w].astype(np.uint64).view(np.int64)) for w in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *signed, pa.array(list(keys), pa.list_(pa.int64()))], ["node", "grp", "f0", "f1", "keys"])

    schema = "node binary, grp string, f0 long, f1 long, keys array<long>"
    coded = nodes.where(F.size("v") == dim).select("node", "grp", "v").mapInArrow(tidy(encode), schema)
    others = nodes.where(F.size("v") != dim).select("node", "grp", F.lit(0).cast("long").alias("f0"), F.lit(0).cast("long").alias("f1"), F.array(F.lit(0).cast("long")).alias("keys"))
    tiles = F.transform("keys", lambda key, table: F.xxhash64("grp", table, key))
    sketches = materialize(coded.unionByName(others).select("node", F.lit(1).cast("long").alias("size"), "f0", "f1", tiles.alias("least")), "sketches")
    near = connected_components(candidate_links(sketches, codes.radius, 1.0))
    # labels are told apart here by themselves, not by a hash of them
    members = nodes.join(near, "node").select(F.struct("component", "grp").alias("tile"), "node", "v", "copies")
    found = materialize(exact_links(members, cosine), "links")
    parts = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    linked = nodes.select("node", "copies", "least_id").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = linked.join(ids, "component").join(counts, "node", "left").select("node", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    whole = rows.select("vec_id", "node")
    told = whole.where("node is not null").join(classes, "node").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return told.unionByName(whole.where("node is null").select("vec_id", *alone))
