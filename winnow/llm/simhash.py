"""SimHash near-duplicates: tiled exact comparison with numpy exclusive-or and bit counts.

`near_duplicates` links fingerprints that differ in at most `radius` bits. Fingerprints are grouped into
tiles by the population counts of their sub-words. Two fingerprints whose counts differ by more than the
radius in sum differ in more than the radius bits, so only tile pairs within it are compared; all of those
are, bit by bit. Tiles are cut into blocks of bounded size, each pair of blocks is one row, dealt by both
tile and block, and a pair returns a spanning forest of its links rather than the links: that keeps every
component and no more than one edge a fingerprint.

`near_texts` links texts whose sets of word shingles have a Jaccard similarity of at least `similarity`.
Its fingerprints have 128 bits over the distinct shingles, and its radius is six standard deviations
above the distance expected at that similarity. At so wide a radius population counts skip next to
nothing, so a tile is the texts that share one of their KEYS least shingle hashes: texts at the similarity
s share none with a chance of about (1 - s) ** KEYS, 3 in a million at 0.8. Within a tile all pairs are
compared by exclusive-or and bit counts, in blocks; what is near there is then compared exactly, shingle
set by shingle set, inside each component of near fingerprints.

Equal fingerprints (equal shingle sets) are one node, so a group of copies of any size is a single row.
Texts without words have fingerprint zero (the empty set) and are linked like any other, nulls among them.
Texts of any length are taken whole, 65,536 shingles at a time. Rows with a null id take part; a
component's id is its least non-null id. Ties and repeated rows are each returned. No rows, no result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import materialize, modest_batches, small_slices, text_of, tidy
from winnow.operators.components import connected_components

#: Upper and lower case of ASCII; the contract's white space, without line separators and the like.
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def words_of(text: str) -> list[bytes]:
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_LOWER).translate(_SPACE).split(b" ") if w]


def _bit_sums(values: np.ndarray) -> np.ndarray:
    """In how many of the values each of the 64 bits is set."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 16):
        part = np.ascontiguousarray(values[at : at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = 3) -> int:
    """The text's SimHash over XXH64 (seed 42) of its word shingles, repeats included."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    stops = (ends - 1).tolist()[shingle - 1 :] or [len(joined)]
    ones, digest, n = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest, len(stops)
    for at in range(0, n, 1 << 16):
        ones += _bit_sums(np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], dtype="<u8"))
    return _majority(ones, n)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_slices(whole, 1, 4 << 20):
                fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return modest_batches(docs).select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(tidy(each), f"doc_id {kind}, fp long")


def sub_words(n: int) -> int:
    """Into how many sub-words a fingerprint is cut for its tile: more for more fingerprints. Exact for any."""
    return 2 if n < 500_000 else 4 if n < 100_000_000 else 8


def near_counts(words: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of tiles to compare: the zero one, and of each pair of opposite ones the positive."""
    zero = (0,) * words
    return [d for d in itertools.product(range(-radius, radius + 1), repeat=words) if sum(map(abs, d)) <= radius and d >= zero]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a[i]-b[i], those that join two trees when taken in turn."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append(i)
    return a[kept], b[kept]


def compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks of fingerprints (within one, if same)."""
    left, right = [], []
    step = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        if near.any():
            i, j = np.nonzero(near)
            if same:
                i, j = i[j > i + at], j[j > i + at]
            left.append(a[at + i])
            right.append(b[j])
            if sum(map(len, left)) > 1 << 20:
                x, y = _forest(np.concatenate(left), np.concatenate(right))
                left, right = [x], [y]
    return _forest(np.concatenate(left), np.concatenate(right)) if left else (a[:0], b[:0])


def links(distinct: DataFrame, radius: int = 2, words: int | None = None, block: int = 4096) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span the components at the radius."""
    words = words or sub_words(distinct.count())
    width = 64 // words
    counts = [F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1) if width < 64 else F.lit(-1))) for k in range(words)]
    tiles = distinct.select("fp", F.array(*counts).alias("tile"))
    # blocks of a tile: so many parts that one holds about `block` fingerprints, dealt by a hash of them
    sizes = materialize(tiles.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "sizes", slim=True)
    dealt = tiles.join(sizes, "tile").select("tile", "fp", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    blocks = materialize(dealt.groupBy("tile", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps")), "tiles")
    # the pairs of blocks are listed first, so that a tile of many blocks is many keys of the joins
    moves = F.array(*[F.array(*map(F.lit, d)) for d in near_counts(words, radius)])
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = sizes.select(F.col("tile").alias("own"), "parts", F.explode(moves).alias("move"))
    left = left.select("own", numbers("parts").alias("i"), F.zip_with("own", "move", lambda x, y: (x + y).cast("int")).alias("tile"), F.forall("move", lambda x: x == 0).alias("same"))
    pairs = left.join(sizes, "tile").select("own", "i", "tile", numbers("parts").alias("part"), "same").where("not same or i <= part")
    pairs = pairs.join(blocks.select(F.col("tile").alias("own"), F.col("part").alias("i"), F.col("fps").alias("left")), ["own", "i"])
    pairs = pairs.join(blocks, ["tile", "part"]).select("left", F.col("fps").alias("right"), F.expr("same and i = part").alias("same"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = [], []
            for k in range(b.num_rows):
                own, other = (b.column(c)[k].values.to_numpy().view(np.uint64) for c in (0, 1))
                x, y = compare(own, other, radius, b.column(2)[k].as_py())
                xs.append(x)
                ys.append(y)
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in (xs, ys)], ["a", "b"])

    return pairs.mapInArrow(tidy(each), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable)."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    parts = connected_components(links(nodes.select("fp"), radius, words)).withColumnRenamed("node", "fp")
    linked = nodes.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = linked.join(ids, "component").select("fp", "component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- texts of a wanted similarity -----------------------------------------------------------------

#: How many of a text's least shingle hashes name the tiles it is compared in.
KEYS = 8
#: Lists of at most so many hashes are broadcast; longer ones are joined by shuffle.
BROADCAST = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = 500_000
_words: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles; of fewer words, of their whole sequence."""
    words = words_of(text)
    if len(_words) > _KEEP:
        _words.clear()
    for w in words:
        if w not in _words:
            _words[w] = xxhash.xxh64_intdigest(w, 7)
    own = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(own))
    h = np.zeros(len(own) - width + 1 if width else 0, dtype=np.uint64)
    for k in range(width):
        h = _mix((h + _ODD) ^ own[k : k + len(h)])
    return np.unique(h)


def wide_fingerprint(values: np.ndarray) -> tuple[int, int]:
    """128 bits of SimHash over a set of hashes, as two unsigned words."""
    return _majority(_bit_sums(values), len(values)), _majority(_bit_sums(_mix(values + _ODD)), len(values))


def radius_of(similarity: float, bits: int = 128) -> int:
    """The distance expected of two sets at a Jaccard similarity, and six standard deviations: sets of a few shingles lie
    further apart, by up to one, as an even number of them leaves bits undecided."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def _sizes_fit(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be so similar."""
    return np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool, sizes: tuple[np.ndarray, np.ndarray], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b (words of a fingerprint) within the radius whose sizes fit, some at a time."""
    step = max(1, (1 << 18) // max(1, len(b)))
    for at in range(0, len(a), step):
        away = sum(np.bitwise_count(a[at : at + step, None, w] ^ b[None, :, w]).astype(np.uint16) for w in range(a.shape[1]))
        i, j = np.nonzero(away <= radius)
        i = i + at
        keep = _sizes_fit(sizes[0][i], sizes[1][j], similarity)
        if same:
            keep &= j > i
        yield i[keep], j[keep]


def _sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, size, f0, f1, least): of each text the digest, size, fingerprint and least hashes of its shingle set."""
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_slices(whole, 1, 4 << 20):
                out: dict[str, list] = {"node": [], "size": [], "f0": [], "f1": [], "least": []}
                for text in b.column(1):
                    values = shingle_set(text.as_py(), shingle)
                    f0, f1 = wide_fingerprint(values)
                    for name, x in zip(out, (xxhash.xxh3_128_digest(values.tobytes()), len(values), f0, f1, values[:KEYS].view(np.int64)), strict=True):
                        out[name].append(x)
                signed = lambda xs: pa.array(np.array(xs, dtype=np.uint64).view(np.int64))
                cols = [b.column(0), pa.array(out["node"], pa.binary()), pa.array(out["size"], pa.int64()), signed(out["f0"]), signed(out["f1"]), pa.array(out["least"], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *out])

    rows = modest_batches(docs).select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(tidy(each), f"doc_id {kind}, node binary, size long, f0 long, f1 long, least array<long>")


def _dealt(rows: DataFrame, tile: str, weight, limit: int) -> tuple[DataFrame, DataFrame]:
    """(tile, parts) of the tiles with two rows or more, and their rows with part and parts: a part has some `limit` of the weight."""
    sizes = materialize(rows.groupBy(tile).agg(F.count("*").alias("n"), F.ceil(F.sum(weight) / limit).cast("int").alias("parts")).where("n > 1").select(tile, "parts"), "sizes", slim=True)
    return sizes, rows.join(sizes, tile).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def _block_pairs(sizes: DataFrame, dealt: DataFrame, tile: str, columns: list[str]) -> DataFrame:
    """(left, right, same): all pairs of blocks of each tile; right is null where a tile is one block, compared with itself."""
    blocks = materialize(dealt.groupBy(tile, "part").agg(F.first("parts").alias("parts"), F.collect_list(F.struct(*columns)).alias("block")), "tiles")
    alone = blocks.where("parts = 1").select(F.col("block").alias("left"), F.lit(None).cast(blocks.schema["block"].dataType).alias("right"), F.lit(True).alias("same"))
    many = blocks.where("parts > 1")
    listed = sizes.where("parts > 1").select(tile, F.explode(F.expr("sequence(0, parts - 1)")).alias("i"), "parts").select(tile, "i", F.explode(F.expr("sequence(i, parts - 1)")).alias("j"))
    one, two = (many.select(tile, F.col("part").alias(k), F.col("block").alias(n)) for k, n in (("i", "left"), ("j", "right")))
    return alone.unionByName(listed.join(one, [tile, "i"]).join(two, [tile, "j"]).select("left", "right", F.expr("i = j").alias("same")))


def _fps(rows: pa.Array) -> np.ndarray:
    return np.stack([rows.field(f).to_numpy().view(np.uint64) for f in ("f0", "f1")], axis=1)


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array(values.tolist(), pa.binary())


def candidate_links(nodes: DataFrame, radius: int, similarity: float, block: int = 4096) -> DataFrame:
    """(a, b): nodes of fitting sizes that share a tile and differ in at most radius bits; a spanning forest of these for each batch of
    small tiles and each pair of blocks of a large one."""
    keyed = nodes.select("node", "size", "f0", "f1", F.explode("least").alias("tile"))
    pairs = _block_pairs(*_dealt(keyed, "tile", F.lit(1), block), "tile", ["node", "size", "f0", "f1"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = [np.empty(0, object)], [np.empty(0, object)]
            rows = b.column(0)
            flat, at = rows.flatten(), (rows.offsets.to_numpy() - rows.offsets[0].as_py() if len(rows) else np.zeros(1, np.int64))
            fps, sets, names = _fps(flat), flat.field("size").to_numpy(), np.array(flat.field("node").to_pylist(), dtype=object)
            single = b.column(1).is_null().to_numpy(zero_copy_only=False)
            size = np.diff(at)
            for n in np.unique(size[single & (size <= 64)]).tolist():  # small tiles of one size at once
                first = at[:-1][single & (size == n)]
                i, j = np.triu_indices(n, 1)
                i, j = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                near = (sum(np.bitwise_count(fps[i, w] ^ fps[j, w]).astype(np.uint16) for w in range(2)) <= radius) & _sizes_fit(sets[i], sets[j], similarity)
                xs.append(names[i[near]])
                ys.append(names[j[near]])
            for k in np.flatnonzero(~single | (size > 64)).tolist():
                own = [x[at[k] : at[k + 1]] for x in (fps, sets, names)]
                same = b.column(2)[k].as_py()
                other = own if same else [_fps(v := b.column(1)[k].values), v.field("size").to_numpy(), np.array(v.field("node").to_pylist(), dtype=object)]
                for i, j in near_pairs(own[0], other[0], radius, same, (own[1], other[1]), similarity):
                    xs.append(own[2][i])
                    ys.append(other[2][j])
                    if sum(map(len, xs)) > 1 << 18:
                        x, y = _forest(np.concatenate(xs), np.concatenate(ys))
                        xs, ys = [x], [y]
            x, y = _forest(np.concatenate(xs), np.concatenate(ys))
            yield pa.RecordBatch.from_arrays([_binary(x), _binary(y)], ["a", "b"])

    return pairs.mapInArrow(tidy(each), "a binary, b binary")


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(a) else 0
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def exact_links(members: DataFrame, sets: DataFrame, radius: int, similarity: float, block_bytes: int = 1 << 20, block_rows: int = 1024) -> DataFrame:
    """(a, b): spanning links, by shingle sets (node, hashes), between the members (component, node, size, f0, f1) of each component.
    A block has some `block_rows` members or `block_bytes`, so that a component of many near texts is many pairs of blocks."""
    weight = F.greatest(64 + 8 * F.col("size"), F.lit(block_bytes // block_rows))
    sizes, dealt = _dealt(members, "component", weight, block_bytes)  # the sets join what is dealt already
    pairs = _block_pairs(sizes, dealt.join(sets, "node"), "component", ["node", "f0", "f1", "hashes"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list] = ([], [])
            for k in range(b.num_rows):
                same, blocks = b.column(2)[k].as_py(), [b.column(0)[k].values]
                if not same:
                    blocks.append(b.column(1)[k].values)
                fps, names = [_fps(x) for x in blocks], [x.field("node").to_pylist() for x in blocks]
                sets = [[np.frombuffer(v, dtype="<u8") for v in x.field("hashes").to_pylist()] for x in blocks]
                sizes = [np.array([len(v) for v in x]) for x in sets]
                parent: dict[bytes, bytes] = {}

                def root(x: bytes, parent=parent) -> bytes:
                    while (p := parent.setdefault(x, x)) != x:
                        parent[x] = x = parent[p]
                    return x

                for left, right in near_pairs(fps[0], fps[-1], radius, same, (sizes[0], sizes[-1]), similarity):
                    for i, j in zip(left.tolist(), right.tolist(), strict=True):
                        x, y = root(names[0][i]), root(names[-1][j])
                        if x != y and _alike(sets[0][i], sets[-1][j], similarity):
                            parent[max(x, y)] = min(x, y)
                            out[0].append(names[0][i])
                            out[1].append(names[-1][j])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], ["a", "b"])

    return pairs.mapInArrow(tidy(each), "a binary, b binary")


def near_texts(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, component_id (the least doc_id of the texts reachable over links of at least the similarity)."""
    radius = radius_of(similarity)
    found = materialize(_sketches(docs, shingle, id_col, text_col), "sketches")
    nodes = materialize(found.groupBy("node").agg(F.min("doc_id").alias("owner"), *[F.first(c).alias(c) for c in ("size", "f0", "f1", "least")]), "nodes")
    near = connected_components(candidate_links(nodes, radius, similarity))
    members = materialize(nodes.join(near, "node").select("node", "component", "owner", "size", "f0", "f1"), "members")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_slices(whole, 1, 4 << 20):
                sets = [shingle_set(t.as_py(), shingle) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    # texts are read again only for what is near: one row of each node, named by its owner. The filter is by a hash, so
    # that a list of up to BROADCAST is 8 bytes a row; what it lets through in error has a node that is no member.
    wanted = materialize(members.select(F.xxhash64("owner").alias("h")).distinct(), "wanted", slim=True)
    rows = docs.select(F.xxhash64(id_col).alias("h"), text_of(text_col).alias("text"))
    texts = modest_batches(rows).join(F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted, "h", "left_semi")
    sets = texts.select("h", "text").mapInArrow(tidy(each), "node binary, hashes binary").dropDuplicates(["node"])
    links = exact_links(members.drop("owner"), sets, radius, similarity)
    parts = connected_components(links)
    linked = nodes.join(parts, "node", "left").select("node", "owner", F.coalesce("component", "node").alias("component"))
    ids = linked.groupBy("component").agg(F.min("owner").alias("component_id"))
    return found.join(linked.join(ids, "component").select("node", "component_id"), "node").select("doc_id", "component_id")
