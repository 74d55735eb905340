"""Benchmark decontamination over a distributed positional inverted index.

Training texts are indexed in segments of about a megabyte: a row holds a segment's documents, its sorted
term hashes, their counts, and all positions, term by term. A frequent word is thus spread over as many
rows as there are segments. A search takes the test items in blocks of bounded size; within a segment each
window starts from its rarest term's positions, which are intersected with the other terms' offset-adjusted
lists from rarest to most frequent.

Words are runs of digits, a-z (A-Z in lower case) and characters above U+007F. Terms are 64-bit hashes.
Null and empty texts have no words and stay in the result. Items without words have no windows; an item
whose id is null counts for hits but is listed nowhere. Repeated rows are each returned. Either table may
be empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import materialize, modest_batches, shared_path, text_of, tidy

_SEGMENT, _HASHED = 1 << 20, 1 << 18


def _splitmix(n: int, seed: int = 1) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1000)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


_BYTES = np.arange(256)
_WORD = (_BYTES >= 48) & (_BYTES <= 57) | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 128)
_VALUE = _splitmix(256)[np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)]
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _powers[size] = tuple(both)
    return _powers[size]


def _hash_part(buf: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of buf; a word ends before each index in fresh."""
    word = _WORD[buf]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[fresh] = False
    starts = np.flatnonzero(word & ~before)
    after = np.zeros_like(word)
    after[:-1] = word[1:] & before[1:]
    ends = np.flatnonzero(word & ~after) + 1
    up, down = _power(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[buf] * up[: len(buf)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29), starts


def hash_words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts bounds[i]:bounds[i+1] of buf, in order, and each text's number of words."""
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + _HASHED)
        while end < len(buf) and _WORD[buf[end]] and _WORD[buf[end - 1]]:  # not inside a word
            end += 1
        lo, hi = np.searchsorted(bounds, [at, end])
        h, s = _hash_part(buf[at:end], bounds[lo:hi] - at)
        hashes.append(h)
        starts.append(s + at)
        at = end
    hashes = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    starts = np.concatenate(starts) if starts else np.empty(0, dtype=np.int64)
    return hashes, np.diff(np.searchsorted(starts, bounds))


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each text starts and ends."""
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, bounds - bounds[0]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the index of all rows to path and return it: segment, doc_ids, n_words, terms, counts, positions.

    Positions are a segment's word numbers, with one free number between documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            buf, bounds = _text_bytes(batch.column(1))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _SEGMENT, side="right")) - 1)
                hashes, words = hash_words(buf[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at])
                place = np.arange(len(hashes), dtype=np.uint32) + np.repeat(np.arange(end - at, dtype=np.uint32), words)
                order = np.argsort(hashes, kind="stable")
                ordered = hashes[order]
                first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
                counts = np.diff(np.append(first, len(ordered))).astype("<u4")
                ids = pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), batch.column(0).slice(at, end - at))
                blobs = [ordered[first].astype("<u8"), counts, place[order].astype("<u4")]
                cols = [pa.array([f"{part}-{made}"]), ids, pa.array([words.tolist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)]
                yield pa.RecordBatch.from_arrays(cols, ["segment", "doc_ids", "n_words", "terms", "counts", "positions"])
                at, made = end, made + 1

    rows = modest_batches(docs).select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    index = rows.mapInArrow(tidy(each), f"segment string, doc_ids array<{kind}>, n_words array<long>, terms binary, counts binary, positions binary")
    path = path or shared_path(docs.sparkSession, "postings")
    small = {"parquet.block.size": str(64 << 20), "parquet.block.size.row.check.min": "8", "parquet.block.size.row.check.max": "16", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.enable.dictionary": "false"}
    index.write.options(**small).parquet(path)
    return docs.sparkSession.read.schema(index.schema).parquet(path)


class Segment:
    """One row of the index, opened for searching."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, n_words: np.ndarray):
        self.terms = np.frombuffer(terms, dtype="<u8")
        self.counts = np.frombuffer(counts, dtype="<u4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.positions = np.frombuffer(positions, dtype="<u4").astype(np.int64)
        self.doc_start = np.cumsum(n_words) - n_words + np.arange(len(n_words))

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted wanted terms: document counts, and keys (number in wanted << 32 | position), sorted."""
        if not len(self.terms) or not len(wanted):
            return np.zeros(len(wanted), dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        df = np.where(self.terms[at] == wanted, self.counts[at], 0)
        return df, np.repeat(np.arange(len(wanted)), df) << 32 | self.positions[_ranges(self.first[at], df)]

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_start, position, side="right") - 1


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... n[i] numbers of each."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def phrases(seg: Segment, wanted: np.ndarray, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (window, position) of windows tokens[start:start+size]; tokens number the sorted wanted terms."""
    df, keys = seg.lists(wanted)
    missing = np.concatenate([[0], np.cumsum(df[tokens] == 0)])
    alive = np.flatnonzero(missing[starts + sizes] == missing[starts])
    found_w, found_p = [], []
    if not len(alive):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.cumsum(df) - df
    width = int(sizes[alive].max())
    at = 0
    while at < len(alive):
        some = alive[at : at + (1 << 16)]
        k = np.minimum(np.arange(width)[None, :], sizes[some][:, None] - 1)  # shorter windows repeat their last term
        term = tokens[starts[some][:, None] + k]
        order = np.argsort(df[term], axis=1, kind="stable")
        rare = np.take_along_axis(term, order[:, :1], 1)[:, 0]
        upto = max(1, int(np.searchsorted(np.cumsum(df[rare]), limit, side="right")))
        some, k, term, order, rare = some[:upto], k[:upto], term[:upto], order[:upto], rare[:upto]
        n = df[rare]
        row = np.repeat(np.arange(len(some)), n)
        begin = (keys[_ranges(first[rare], n)] & 0xFFFFFFFF) - np.repeat(np.take_along_axis(k, order[:, :1], 1)[:, 0], n)
        row, begin = row[begin >= 0], begin[begin >= 0]
        for j in range(1, width):
            if not len(row):
                break
            o = order[row, j]
            key = term[row, o] << 32 | (begin + k[row, o])
            where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            row, begin = row[hit := keys[where] == key], begin[hit]
        found_w.append(some[row])
        found_p.append(begin)
        at += upto
    return np.concatenate(found_w), np.concatenate(found_p)


def item_tokens(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text", chunk: int = 1 << 16) -> DataFrame:
    """(item, words): an item's word hashes, long items in chunks that overlap by window - 1 words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = _text_bytes(batch.column(1))
            hashes, words = hash_words(buf, bounds)
            rows, blobs, done = [], [], 0
            for i, n in enumerate(words.tolist()):
                own, done = hashes[done : done + n], done + n
                for at in range(0, max(1, n - window + 1), chunk):
                    if n:
                        rows.append(i)
                        blobs.append(own[at : at + chunk + window - 1].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(blobs, pa.binary())], ["item", "words"])

    return items.select(F.col(id_col).cast("string").alias("item"), text_of(text_col).alias("text")).mapInArrow(each, "item string, words binary")


def search(index: DataFrame, items: DataFrame, window: int = 13, block_words: int = 1 << 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per indexed document: doc_id, n_words, n_hit, spans (hit word ranges, end exclusive) and item_ids.

    The items' words are read in blocks of about block_words, each a search of its own.
    """
    spark = index.sparkSession
    words = materialize(item_tokens(items, window, id_col, text_col).distinct(), "items")  # rows that repeat ask once
    total = words.agg(F.coalesce(F.sum(F.octet_length("words") / 8), F.lit(0.0))).first()[0]
    blocks = max(1, math.ceil(total / block_words))
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"segment string, nth long, doc_id {kind}, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"
    parts = []
    for b in range(blocks):
        rows = words.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).collect()  # about block_words words
        lists = [np.frombuffer(bytes(r["words"]), dtype="<u8") for r in rows]
        wanted, tokens = np.unique(np.concatenate(lists), return_inverse=True) if lists else (np.empty(0, np.uint64), np.empty(0, np.int64))
        starts, sizes, owner, at = [], [], [], 0
        for i, x in enumerate(lists):
            n = max(1, len(x) - window + 1)
            starts.append(np.arange(n) + at)
            sizes.append(np.full(n, min(window, len(x))))
            owner.append(np.full(n, i))
            at += len(x)
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        given = spark.sparkContext.broadcast((wanted, tokens.astype(np.int64), join(starts), join(sizes), join(owner), [r["item"] for r in rows]))
        found = index.mapInArrow(tidy(_searcher(given, only_hits=b > 0)), schema)
        parts.append(found if blocks == 1 else materialize(found, "hits"))
    if blocks > 1:
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        both = every.groupBy("segment", "nth").agg(
            F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")
        )
        # ranges are sorted: each is cut where the furthest end before it lies
        seen = "aggregate(slice(spans, 1, i), 0L, (m, s) -> greatest(m, s.end))"
        clipped = f"filter(transform(spans, (s, i) -> struct(greatest(s.start, {seen}) AS start, s.end AS end)), s -> s.start < s.end)"
        parts = [both.withColumn("spans", F.expr(clipped))]
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return parts[0].select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "item_ids")


def _searcher(given, only_hits: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, tokens, starts, sizes, owner, names = given.value
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n_words = batch.column(1)[r].values, batch.column(2)[r].values.to_numpy(zero_copy_only=False)
                seg = Segment(*(batch.column(c)[r].as_py() for c in (3, 4, 5)), n_words)
                w, p = phrases(seg, wanted, tokens, starts, sizes)
                spans, items = [[] for _ in n_words], [[] for _ in n_words]
                if len(w):
                    size = int(n_words.sum()) + len(n_words)
                    edge = np.bincount(p, minlength=size + 1) - np.bincount(p + sizes[w], minlength=size + 1)
                    hit = np.diff(np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8))
                    begin, end = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
                    for d, x, y in zip((doc := seg.doc_of(begin)).tolist(), (begin - seg.doc_start[doc]).tolist(), (end - seg.doc_start[doc]).tolist(), strict=True):
                        spans[d].append({"start": x, "end": y})
                    for d, i in np.unique(np.stack([seg.doc_of(p), owner[w]], axis=1), axis=0).tolist():
                        if names[i] is not None:
                            items[d].append(names[i])
                keep = [i for i in range(len(n_words)) if spans[i] or not only_hits]
                cols = {
                    "segment": pa.array([batch.column(0)[r].as_py()] * len(keep), pa.string()), "nth": pa.array(keep, pa.int64()), "doc_id": ids.take(pa.array(keep, pa.int64())),
                    "n_words": pa.array(n_words[keep], pa.int64()), "spans": pa.array([spans[i] for i in keep], pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))),
                    "item_ids": pa.array([sorted(set(items[i])) for i in keep], pa.list_(pa.string())),
                }
                yield pa.RecordBatch.from_pydict(cols)

    return each


def proximity(index: DataFrame, query: str, slop: int) -> DataFrame:
    """(doc_id, start, end): for each occurrence of the query's rarest word, the smallest window of its document that
    holds it and an occurrence of every other word (the first of several), where that spans at most slop words."""
    raw = np.frombuffer(query.encode(), dtype=np.uint8)
    wanted = np.unique(hash_words(raw, np.array([0, len(raw)]))[0])
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n_words = batch.column(2)[r].values.to_numpy(zero_copy_only=False)
                seg = Segment(*(batch.column(c)[r].as_py() for c in (3, 4, 5)), n_words)
                df, keys = seg.lists(wanted)
                if not len(wanted) or not df.all():
                    continue
                lists = sorted((keys[keys >> 32 == t] & 0xFFFFFFFF for t in range(len(wanted))), key=len)
                begins = np.unique(np.concatenate(lists))  # where a window can begin, and from there the next of every word
                ends = np.max([np.append(x, 1 << 40)[np.searchsorted(x, begins)] for x in lists], axis=0)
                mid = lists[0]
                doc = seg.doc_of(mid)
                first = np.searchsorted(begins, np.maximum(mid - slop + 1, seg.doc_start[doc]))
                n = np.searchsorted(begins, mid, side="right") - first
                after = seg.doc_start[doc] + n_words[doc]
                lo, hi = np.zeros_like(mid), np.full_like(mid, 1 << 40)
                for k in range(int(n.max(initial=0))):
                    at = np.minimum(first + k, len(begins) - 1)
                    end = np.maximum(ends[at], mid)
                    better = (k < n) & (end < after) & (end - begins[at] < hi - lo)
                    lo, hi = np.where(better, begins[at], lo), np.where(better, end, hi)
                ok = hi - lo < slop
                doc = seg.doc_of(lo[ok])
                cols = [batch.column(1)[r].values.take(pa.array(doc)), pa.array(lo[ok] - seg.doc_start[doc]), pa.array(hi[ok] - seg.doc_start[doc] + 1)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "end"])

    return index.mapInArrow(each, f"doc_id {kind}, start long, end long")


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """search() over a fresh index of docs, with the verdict: a twentieth of the words or more are hit."""
    found = search(build_index(docs, id_col, path=path), items, window)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
