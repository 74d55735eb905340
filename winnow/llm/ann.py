"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, best-bin-first traversal through
a priority queue, and leaf visits widened until the recall calibrated against brute force is reached.

The tree is fitted on a bounded sample of the vectors (`sample` of them, fewer if they hold over 2**23
components; those with the least hash of their id) and has at most `leaves` leaves, so it is broadcast; every vector is put in a leaf. Leaves are
stored in blocks of bounded size, so a leaf with many vectors is many rows. Vectors that are equal, component
by component, are one row with their k + 1 least ids, the only ones that can be among a query's k nearest.
Calibration takes up to `probes` of the queries, finds their true neighbours among all rows, and visits as
many leaves as put the target share of them in reach.

Vectors that are null, all zero, hold null or non-finite components, or have another dimension than most
rows (the smaller on a tie) take no part; nor do null ids. An id repeated with several vectors counts once
for each, and as a query asks with the least of them. Fewer candidates than k are all returned; ties go to
the smaller id. Empty tables give no rows.

Queries go out in blocks of some `ask` components (8 MB), broadcast; what is shuffled is which of them ask
which leaf, not their vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import materialize, modest_batches, shared_path

_ROUNDS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(_ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    return centres, np.argmax(x @ centres.T, axis=1)


class Tree:
    """centres[i] and children[i] of each node; a node without children is a leaf with a number."""

    def __init__(self, x: np.ndarray, branch: int = 8, leaves: int = 1024, least: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres, self.children = [x.mean(axis=0)], [[]]
        todo, count = [(-len(x), 0, np.arange(len(x)))], 1
        while todo:  # the largest node is split first
            _, node, rows = heapq.heappop(todo)
            k = min(branch, len(rows) // least, leaves - count + 1)
            if k < 2:
                continue
            centres, own = _kmeans(x[rows], k, rng)
            parts = [rows[own == j] for j in range(k)]
            if max(map(len, parts)) == len(rows):
                continue
            for c, part in zip(centres, parts, strict=True):
                if len(part):
                    self.children[node].append(len(self.centres))
                    self.centres.append(c)
                    self.children.append([])
                    heapq.heappush(todo, (-len(part), len(self.centres) - 1, part))
            count += len(self.children[node]) - 1
        self.centres = np.array(self.centres)
        self.leaf = {n: i for i, n in enumerate(n for n, c in enumerate(self.children) if not c)}

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, going to the nearest child at each node."""
        out, todo = np.zeros(len(x), dtype=np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if kids := self.children[node]:
                own = np.argmax(x[rows] @ self.centres[kids].T, axis=1)
                todo += [(kid, part) for j, kid in enumerate(kids) if len(part := rows[own == j])]
            else:
                out[rows] = self.leaf[node]
        return out

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves for a query, the most promising bin first."""
        queue = [(-1.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if kids := self.children[node]:
                for kid, s in zip(kids, (self.centres[kids] @ q).tolist(), strict=True):
                    heapq.heappush(queue, (-s, kid))
            else:
                yield self.leaf[node]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.list_(pa.float64()))
    return column.flatten().to_numpy().reshape(len(column), -1)


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with q, in double precision, each summed alike whatever the block."""
    a, b = np.abs(x).max(axis=1), np.abs(q).max()
    x, q = x / a[:, None], q / b
    return (x * q).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (q * q).sum())


def _nearest(x: np.ndarray, unit: np.ndarray, q: np.ndarray, q_unit: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: rows of x that may be among its k + 1 nearest here, and their exact scores."""
    close = q_unit @ unit.T
    keep = min(k + 1, len(x))
    bar = np.partition(close, len(x) - keep, axis=1)[:, len(x) - keep] - 1e-9
    for i in range(len(q)):
        at = np.flatnonzero(close[i] >= bar[i])
        yield i, at, exact_scores(x[at], q[i])


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    kind = df.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>")  # floats stay half as wide until they are compared
    ok = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.where(F.col(id_col).isNotNull() & ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (dim["d"] if dim else 0))


def nearest(df: DataFrame, is_query: Column, k: int = 5, recall: float = 0.96, sample: int = 16_384, leaves: int = 1024, probes: int = 128, block: int = 1024, ask: int = 1 << 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row of df for which is_query holds."""
    spark = df.sparkSession
    queries_of = modest_batches(df).where(is_query)
    valid = materialize(valid_vectors(df, id_col, vec_col), "vectors")
    asked = materialize(valid_vectors_like(queries_of, valid, id_col, vec_col), "queries")
    wide = valid.schema["v"].dataType.simpleString()
    dim = (valid.select(F.size("v").alias("d")).first() or {"d": 1})["d"]
    sample = min(sample, max(1, (1 << 23) // dim))
    picked = valid.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()  # bounded by `sample`
    if not picked.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(_unit(_matrix(picked.column(0).combine_chunks())), leaves=leaves)
    given = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(given.value.assign(_unit(_matrix(b.column(0))))))

    # the least ids of each vector; ranks are limited before the shuffle, so copies of one vector stay few
    first = valid.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    distinct = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    leafed = materialize(distinct.mapInArrow(place, f"v {wide}, ids array<long>, leaf int"), "leaves")
    sizes = leafed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"))
    parts = sizes.select("leaf", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = leafed.join(F.broadcast(parts), "leaf").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))  # a row per leaf
    blocks = materialize(dealt.groupBy("leaf", "part").agg(F.collect_list(F.struct("v", "ids")).alias("rows")), "blocks")
    held = {r["leaf"]: r["ids"] for r in sizes.collect()}  # at most `leaves` rows

    visits = calibrate(valid, asked, tree, k, recall, probes)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows, where = [], []
            for i, q in enumerate(_unit(_matrix(b.column(1)))):
                seen = 0
                for n, leaf in enumerate(given.value.best_first(q)):
                    if n >= visits and seen > k:
                        break
                    if leaf in held:
                        rows.append(i)
                        where.append(leaf)
                        seen += held[leaf]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(where, pa.int32())], ["id", "leaf"])

    def meeting(given):
        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_ids, all_q, all_unit = given.value
            for b in batches:
                for r in range(b.num_rows):
                    rows, q_ids = b.column(0)[r].values, b.column(1)[r].values.to_numpy()
                    x, ids = _matrix(rows.field("v")), rows.field("ids")
                    asking = np.searchsorted(all_ids, q_ids)
                    out = {"query_id": [], "vec_id": [], "score": []}
                    for i, at, scores in _nearest(x, _unit(x), all_q[asking], all_unit[asking], k):
                        for a, s in zip(at.tolist(), scores.tolist(), strict=True):
                            for v in ids[a].as_py():
                                if v != q_ids[i]:
                                    out["query_id"].append(int(q_ids[i]))
                                    out["vec_id"].append(v)
                                    out["score"].append(s)
                    yield pa.RecordBatch.from_pydict(out, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

        return meet

    schema = "query_id long, vec_id long, score double"
    path = shared_path(spark, "met")
    spark.createDataFrame([], schema).write.parquet(path)
    deals = max(1, -(-asked.count() * dim // ask))
    for deal in range(deals):  # a deal's results are written before the next is sent
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(deals)) == deal)
        some = own.orderBy("id").toArrow()  # about `ask` components
        if not some.num_rows:
            continue
        q = _matrix(some.column("v").combine_chunks())
        block_of = spark.sparkContext.broadcast((some.column("id").to_numpy(), q, _unit(q)))
        asks = own.repartition(max(1, min(1000, some.num_rows // 64))).mapInArrow(visit, "id long, leaf int").groupBy("leaf").agg(F.sort_array(F.collect_list("id")).alias("asks"))
        met = blocks.join(asks, "leaf").select("rows", "asks").mapInArrow(meeting(block_of), schema)
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        met.withColumn("rank", first).where(F.col("rank") <= k).drop("rank").write.mode("append").parquet(path)
        block_of.destroy()
    found = spark.read.schema(schema).parquet(path)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def valid_vectors_like(queries: DataFrame, valid: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """The queries that take part: those whose vectors are among the valid ones."""
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    return valid.join(asked.distinct(), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))


def brute_force(valid: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank, v): true neighbours of a bounded set of queries among all rows."""
    given = valid.sparkSession.sparkContext.broadcast((q_ids, q, _unit(q)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, unit = given.value
        for b in batches:
            if not b.num_rows:
                continue
            x, names = _matrix(b.column(1)), b.column(0).to_numpy()
            rows, query, score = [], [], []
            for i, at, s in _nearest(x, _unit(x), own, unit, k):
                order = np.lexsort((names[at], -s))[: k + 1]
                keep = order[names[at[order]] != ids[i]]
                rows += at[keep].tolist()
                query += [int(ids[i])] * len(keep)
                score += s[keep].tolist()
            take = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), take.column(0), pa.array(score, pa.float64()), take.column(1)], ["query_id", "vec_id", "score", "v"])

    found = valid.mapInArrow(each, f"query_id long, vec_id long, score double, v {valid.schema['v'].dataType.simpleString()}")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k)


def calibrate(valid: DataFrame, asked: DataFrame, tree: Tree, k: int, recall: float, probes: int) -> int:
    """How many leaves to visit for the wanted share of the true neighbours of up to `probes` queries."""
    few = asked.orderBy(F.xxhash64("id"), "id").limit(probes).toArrow()
    if not few.num_rows:
        return 1
    ids, q = few.column(0).to_numpy(), _matrix(few.column(1).combine_chunks())
    true = brute_force(valid, ids, q, k).select("query_id", "v").toArrow()  # k rows a probe
    if not true.num_rows:
        return 1
    leaf = tree.assign(_unit(_matrix(true.column(1).combine_chunks())))
    turn = {i: {l: n for n, l in enumerate(tree.best_first(u))} for i, u in zip(ids.tolist(), _unit(q), strict=True)}
    needed = np.sort([turn[i][l] + 1 for i, l in zip(true.column(0).to_pylist(), leaf.tolist(), strict=True)])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
