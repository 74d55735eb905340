"""Sequence packing: shortest-pack-first over the length histogram.

Documents are encoded once; each is cut into full sequences and one remainder. The histogram of piece
lengths (at most max_len rows, whatever the corpus) goes to the driver, where lengths are placed longest
first into the emptiest pattern that holds them, updating pattern counts. A pattern's slots own ranges of
ranks within a length, so pieces find their sequence by (length, rank): no pair or group is ever gathered.

Null or empty texts are one closing id. Texts of any length are encoded whole and cut into as many pieces as they need.
Pieces of one length are interchangeable: which of them takes which place is settled by their rank, and ranks by the
partition a row is in, so ties may fall otherwise in another run, with the same padding. Repeated rows, and rows whose
id is null or repeats, are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winnow.llm.common import materialize, modest_batches, small_slices, text_of, tidy
from winnow.llm.tokens import encoder, vocabulary


def encode_pieces(docs: DataFrame, file: str, max_len: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, part and local_rank (the piece's place among
    those of its length in this task), and ids (uint32, little-endian) if kept."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, part long, local_rank long" + ", ids binary" * keep_ids
    closing = np.uint32(end_id).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(file), TaskContext.get().partitionId(), np.zeros(max_len + 1, dtype=np.int64)
        for whole in batches:
            for batch in small_slices(whole, 1, 4 << 20):
                rows, starts, lengths, crcs, totals, ranks, kept = [], [], [], [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    ids = enc.encode(text) + closing
                    n = len(ids) // 4
                    for at in range(0, n, max_len):
                        piece = ids[4 * at : 4 * (at + max_len)]
                        length = len(piece) // 4
                        rows.append(i)
                        starts.append(at)
                        lengths.append(length)
                        crcs.append(zlib.crc32(piece))
                        totals.append(n)
                        ranks.append(seen[length])
                        seen[length] += 1
                        if keep_ids:
                            kept.append(piece)
                long = lambda x: pa.array(x, pa.int64())
                cols = [batch.column(0).take(long(rows)), long(starts), long(lengths), long(crcs), long(totals), long([part] * len(rows)), long(ranks)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local_rank"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return modest_batches(docs).select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(tidy(cut), schema)


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (count, [(length, copies), ...]) that place every piece of the histogram once.

    Lengths go longest first into the pattern with the most room. Copies of one length go into a pattern
    together until it is no longer the emptiest. Where no pattern has room, new packs take as many copies as fit.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    heap: list[int] = []

    def put(space: int, count: int, runs: list[tuple[int, int]]) -> None:
        if not room.get(space):
            room[space] = []
            heapq.heappush(heap, -space)
        room[space].append((count, runs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and -heap[0] >= length:
            space = -heap[0]
            count, runs = room[space].pop()
            if not room[space]:
                heapq.heappop(heap)
            nxt = -heap[0] if heap else 0
            if left < count:
                put(space, count - left, runs)
                count = left
            copies = max(1, min(space // length, left // count, -(-(space - nxt) // length)))
            left -= count * copies
            same = runs[-1][0] == length
            put(space - copies * length, count, [*runs[:-1], (length, runs[-1][1] + copies)] if same else [*runs, (length, copies)])
        if left:
            each = max_len // length
            if left // each:
                put(max_len - each * length, left // each, [(length, each)])
            if left % each:
                put(max_len - (left % each) * length, 1, [(length, left % each)])
    return [p for space in sorted(room) for p in room[space]]


def slot_ranges(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), by length and rank."""
    taken: dict[int, int] = {}
    out, base = [], 0
    for count, runs in patterns:
        offset = 0
        for length, copies in runs:
            first = taken.get(length, 0)
            out.append((length, first, base, copies, offset))
            taken[length] = first + count * copies
            offset += length * copies
        base += count
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, file: str | None = None, max_len: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    pieces = materialize(encode_pieces(docs, file or vocabulary(), max_len, end_id, id_col, text_col, keep_ids), "pieces")
    by_task = pieces.groupBy("part", "length").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(by_task.select("part", "length", before.alias("before")), ["part", "length"])
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    slots = slot_ranges(shortest_pack_first(histogram, max_len))
    keys = slots[:, 0] << 48 | slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            found = slots[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth, copies = rank - found[:, 1], found[:, 3]
            out = {n: b.column(b.schema.get_field_index(n)) for n in names}
            out |= {"sequence_id": pa.array(found[:, 2] + nth // copies), "offset": pa.array(found[:, 4] + nth % copies * length)}
            yield pa.RecordBatch.from_pydict(out)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    rows = ranked.select(*names, (F.col("before") + F.col("local_rank")).alias("rank"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(place, ", ".join(f"{n} {types[n]}" for n in names) + ", sequence_id long, offset long")
