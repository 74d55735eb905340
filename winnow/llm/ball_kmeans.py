"""Exact k-means with clusters as balls, in integer arithmetic.

A cluster is a ball: its centroid and a radius that no member passes. After each round the radius is bounded by
the farthest member's distance to the old centroid and the way the centroid moved, so no scan is needed for it.
Only centroids nearer than twice the radius are neighbours of the ball. A member at distance d from its centroid
can be as near to another one only if that lies within 2 d of its own: members nearer than half the way to
the nearest neighbour are the stable core and are compared with none, those further out, annulus by annulus, with
that many neighbours, exactly. The rest of the centroids is skipped for good reason, so the result is that of the
plain algorithm, ties included (the smaller number wins).

A round is a scan of the table of vectors and their clusters, written anew in the shared folder, and a scan of that
for sums per task and cluster; centroids (k of them) are all that reaches the driver and the tasks. Nothing is
shuffled but k sums a task, so a cluster with any share of the rows is as many tasks as its rows are.

Vectors that are null, of another length, hold null or non-finite components, or a component so large that squared
distances pass a long (2 ** 27 after scaling) take no part and are not returned. Rows that repeat an id or a vector
are each clustered; null ids come last among the first centroids. Fewer vectors than k are as many centroids;
no vectors, no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import discard, materialize, modest_batches, tidy

LARGEST = 1 << 27
_STATE = "id {id}, v array<int>, cluster int, distance long"


def whole_vectors(df: DataFrame, dim: int, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the vectors that take part, each component x as the integer floor(scale * x)."""
    v = F.transform(F.col(vec_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    fits = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) <= LARGEST))  # no NaN and no infinity passes
    ok = (F.size(vec_col) == dim) & F.coalesce(fits, F.lit(False))
    return modest_batches(df).where(ok).select(F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x).cast("int")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from a centre."""
    away = x - centre
    return np.einsum("ij,ij->i", away, away)


class Balls:
    """Centroids and, per ball, its neighbours by distance; a ball without a radius has no members."""

    def __init__(self, centres: np.ndarray, radii: dict[int, float]):
        self.centres, self.near, self.reach = centres, {}, {}
        for i, radius in radii.items():
            apart = squares(centres, centres[i])
            apart[i] = -1
            others = np.argsort(apart, kind="stable")[1:]
            others = others[apart[others] <= 4 * radius * radius * (1 + 1e-9) + 1]  # a slack for the square roots
            self.near[i], self.reach[i] = others, apart[others]

    def assign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each row and its squared distance, given the ball the row was in; and how many distances that took."""
        cluster, distance, compared = own.copy(), np.empty(len(x), np.int64), len(x)
        for i in np.unique(own).tolist():
            rows = np.flatnonzero(own == i)
            members = x[rows]
            best, who = squares(members, self.centres[i]), np.full(len(rows), i)
            ring = np.searchsorted(self.reach[i], 4 * best, side="right")  # 0: the core
            for n, j in enumerate(self.near[i].tolist()):
                some = np.flatnonzero(ring > n)
                if not len(some):
                    break
                compared += len(some)
                d = squares(members[some], self.centres[j])
                closer = (d < best[some]) | ((d == best[some]) & (j < who[some]))
                best[some[closer]], who[some[closer]] = d[closer], j
            cluster[rows], distance[rows] = who, best
        return cluster, distance, compared


def assign_first(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, with no ball known."""
    best, who = squares(x, centres[0]), np.zeros(len(x), dtype=np.int32)
    for j in range(1, len(centres)):
        d = squares(x, centres[j])
        closer = d < best
        best[closer], who[closer] = d[closer], j
    return who, best


def _round(state: DataFrame, centres: np.ndarray, balls: Balls | None) -> DataFrame:
    """state with each vector's nearest centroid and its distance, as a written table."""
    spark, kind = state.sparkSession, state.schema["id"].dataType.simpleString()
    given = spark.sparkContext.broadcast((centres, balls))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, known = given.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            cluster, distance = assign_first(x, first) if known is None else known.assign(x, b.column(2).to_numpy())[:2]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "v", "cluster", "distance"])

    done = materialize(state.mapInArrow(tidy(each), _STATE.format(id=kind)), "balls")
    given.destroy()
    return done


def _sums(state: DataFrame, dim: int) -> dict[int, tuple[int, int, list[int]]]:
    """Per cluster with members: their number, the largest squared distance, and the sums of their components."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, own, distance = _matrix(b.column(0)), b.column(1).to_numpy(), b.column(2).to_numpy()
            for i in np.unique(own).tolist():
                rows = own == i
                n, far, sums = found.get(i, (0, 0, np.zeros(dim, np.int64)))
                found[i] = [n + int(rows.sum()), max(far, int(distance[rows].max())), sums + x[rows].sum(axis=0)]
        cols = [pa.array(list(found), pa.int32()), *(pa.array([f[k] for f in found.values()], pa.int64()) for k in (0, 1)), pa.array([f[2] for f in found.values()], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["cluster", "n", "far", "sums"])

    parts = state.select("v", "cluster", "distance").mapInArrow(tidy(each), "cluster int, n long, far long, sums array<long>")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = parts.select("cluster", "n", "far", F.posexplode("sums")).groupBy("cluster", "pos").agg(whole("n").alias("n"), F.max("far").alias("far"), whole("col").alias("sum"))
    found: dict[int, tuple[int, int, list[int]]] = {}
    for r in rows.collect():  # k * dim rows
        found.setdefault(r["cluster"], (int(r["n"]), r["far"], [0] * dim))[2][r["pos"]] = int(r["sum"])
    return found


def ball_kmeans(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per vector that takes part: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its components)."""
    spark = df.sparkSession
    state = materialize(whole_vectors(df, dim, scale, id_col, vec_col), "whole")
    kind = state.schema["id"].dataType.simpleString()
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    picked = state.orderBy(draw.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    names = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not picked:
        return spark.createDataFrame([], names)
    centres = np.array([r["v"] for r in picked], dtype=np.int64)
    balls = None
    for turn in range(rounds + 1):
        before, state = state, _round(state, centres, balls)
        discard(before)
        if turn == rounds:
            break
        moved, radii = centres.copy(), {}
        for i, (n, far, sums) in _sums(state, dim).items():
            moved[i] = [s // n for s in sums]
            radii[i] = math.sqrt(far) + math.sqrt(int(squares(moved[i : i + 1], centres[i])[0]))
        centres, balls = moved, Balls(moved, radii)
    spread = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    listed = [(i, d, sum(spread.values()), centres[i].tolist()) for i, d in spread.items()]
    about = spark.createDataFrame(listed, "cluster int, cluster_inertia long, inertia long, centroid array<long>")  # k rows at most
    return state.withColumnRenamed("id", "vec_id").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(components: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()
