"""Near-duplicate vectors, ball k-means and the Merkle manifest against brute force, and the defined results of odd rows."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.llm import ball_kmeans, itq, merkle, queries

VECTORS = "vec_id long, embedding array<float>, label int"
nan, inf = math.nan, math.inf


# --- near-duplicate vectors -------------------------------------------------------------------------


def plain_links(rows, cosine=0.98):
    """What op11 returns, by comparing all pairs."""
    ok = [v is not None and l is not None and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, l in rows]
    linked = [[] for _ in rows]
    for i, (_, v, l) in enumerate(rows):
        for j, (_, w, m) in enumerate(rows[:i]):
            if ok[i] and ok[j] and l == m and len(v) == len(w):
                a, b = np.asarray(v, np.float32).astype(float), np.asarray(w, np.float32).astype(float)
                if (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()) >= cosine:
                    linked[i].append(j)
                    linked[j].append(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(linked[i]), least, least is not None and rows[i][0] == least))
    return sorted(out, key=str)


def near_rows(seed, n, dim, labels=3):
    """Vectors alone, groups of copies, of scaled copies, of near copies about the threshold, and one group of a third of all rows."""
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base, label = rng.standard_normal(dim), int(rng.integers(labels))
        size, away = (n // 3, 0.12) if not rows else [(1, 0), (4, 0), (5, 0.1), (9, 0.17), (2, 0.12), (1, 0)][rng.integers(6)]
        for _ in range(size):
            v = base / np.linalg.norm(base) + away * rng.standard_normal(dim) / math.sqrt(dim)
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([1, 1, 3])], label))
    return rows[:n]


def links_of(df, **more):
    return sorted((tuple(r) for r in itq.near_vectors(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize(("seed", "dim"), [(1, 64), (2, 24), (3, 3)])
def test_near_vectors_agree_with_brute_force(spark, seed, dim):
    rows = near_rows(seed, 400, dim)
    assert links_of(spark.createDataFrame(rows, VECTORS)) == plain_links(rows)


def test_near_vectors_in_small_blocks(spark, monkeypatch):
    rows = near_rows(4, 300, 16, labels=2)
    whole, dealt = itq.exact_links, itq._dealt
    monkeypatch.setattr(itq, "exact_links", lambda members, cosine: whole(members, cosine, block_bytes=1 << 10))
    seen = []
    monkeypatch.setattr(itq, "_dealt", lambda *a: (seen.append(r := dealt(*a)), r)[1])
    assert links_of(spark.createDataFrame(rows, VECTORS)) == plain_links(rows)
    assert seen[0][0].agg(F.max("parts")).first()[0] > 3


def test_near_vectors_of_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 3.0], 1), (5, [1.0, nan, 3.0], 1), (6, [1.0, inf, 3.0], 1), (7, v, None),
        (8, v, 1), (9, [2.0, 4.0, 6.0], 1), (9, v, 1), (9, [-1.0, 0.0, 0.0], 1), (10, v, 2), (None, v, 1), (None, [5.0, -1.0, 0.0], 3), (11, [1.0, 2.0], 1), (12, [1.0, 2.0], 1), (13, [1e-30, 2e-30, 3e-30], 1), (14, [3e38, 3e38, 3e38], 1),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("node", "grp", "v", "copies", "component", "tile")})
    assert links_of(df) == plain_links(rows)
    assert itq.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert links_of(spark.createDataFrame(rows[:7], VECTORS)) == plain_links(rows[:7])


def test_codes_are_balanced_and_near_vectors_share_a_bucket():
    rng = np.random.default_rng(5)
    x = itq._unit(rng.standard_normal((3000, 64)) * np.linspace(0.3, 2, 64) + 0.2)
    codes = itq.Codes(x, 0.98, group=5000)
    words, keys = codes.of(x)
    ones = np.unpackbits(words.view(np.uint8), axis=1).mean(axis=0)
    assert 0.45 < ones.min() and ones.max() < 0.55
    turn = codes.turns[0]
    assert np.allclose(turn @ turn.T, np.eye(64))
    y = itq.turned(x, 0.98, np.random.default_rng(6))
    assert np.allclose((x * y).sum(axis=1), 0.98)
    words_y, keys_y = codes.of(y)
    apart = np.bitwise_count(words ^ words_y).sum(axis=1)
    assert (keys == keys_y).any(axis=1).mean() > 0.998 and (apart <= codes.radius).mean() > 0.999
    assert (keys == np.roll(keys, 1, axis=0)).mean() < 0.01  # vectors that are not near seldom meet


def test_iterative_quantisation_brings_the_sample_nearer_to_its_signs():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2000, 16)) * np.linspace(0.2, 3, 16)
    loss = lambda turn: ((np.sign(x @ turn) - x @ turn) ** 2).sum()
    assert loss(itq.rotation(x, rng)) < min(loss(np.linalg.qr(rng.standard_normal((16, 16)))[0]) for _ in range(20))


# --- ball k-means -----------------------------------------------------------------------------------


def plain_kmeans(rows, k, rounds, dim, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and abs(x * scale) <= ball_kmeans.LARGEST for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        own = [min((apart(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centres)):
                if members := [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]:
                    centres[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    sums = {j: sum(d for d, o in own if o == j) for j in range(len(centres))}
    return sorted(((i, j, d, sums[j], sum(sums.values()), ",".join(map(str, centres[j]))) for (i, _), (d, j) in zip(kept, own, strict=True)), key=str)


def clusters_of(df, **more):
    rows = ball_kmeans.ball_kmeans(df, **more).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.array_join(F.col("centroid").cast("array<string>"), ",")).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("spread", [0.02, 0.4, 3.0])
def test_ball_kmeans_agrees_with_plain_kmeans(spark, spread):
    rng = np.random.default_rng(8)
    middles = rng.standard_normal((6, 5))
    rows = [(i, [float(x) for x in middles[i % 6 if i % 3 else 0] + spread * rng.standard_normal(5)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(150)]  # a third of all rows is one vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clusters_of(df, k=9, dim=5) == plain_kmeans(rows, 9, 5, 5)


def test_balls_skip_what_cannot_be_nearer():
    rng = np.random.default_rng(9)
    centres = rng.integers(-2000, 2000, (20, 8))
    own = rng.integers(0, 20, 4000)
    x = centres[own] + rng.integers(-300, 300, (4000, 8))
    radii = {i: math.sqrt(ball_kmeans.squares(x[own == i], centres[i]).max()) for i in range(20)}
    cluster, distance, compared = ball_kmeans.Balls(centres, radii).assign(x, own)
    plain = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (cluster == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    assert compared < 1.2 * len(x)  # one distance for the core, few for the annuli


def test_equal_centroids_and_ties_go_to_the_smaller_number():
    centres = np.array([[0, 0], [4, 0], [4, 0], [0, 4]])
    x = np.array([[2, 0], [2, 2], [4, 0], [0, 2]])
    balls = ball_kmeans.Balls(centres, {2: 10.0, 3: 10.0})
    assert balls.assign(x, np.array([2, 3, 2, 3]))[0].tolist() == [0, 0, 1, 0]


def test_ball_kmeans_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [1.0, -0.5]), (7, [1.0, -0.5]), (8, [-0.001, 0.0]), (None, [3.0, 3.0]), (9, [1e30, 0.0]), (10, [2.0, 2.0, 2.0]), (11, [-524287.9, 524287.9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "v", "cluster", "distance", "pos")})
    for k in (2, 40):
        assert clusters_of(df, k=k, dim=2) == plain_kmeans(rows, k, 5, 2)
    assert clusters_of(spark.createDataFrame([], "vec_id long, embedding array<double>")) == []
    assert clusters_of(df.where("vec_id < 6"), dim=2) == []


# --- the Merkle manifest ----------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_paths(leaves):
    """The root and, per leaf, its siblings from below: (side, hash), or None where it is alone."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(leaves)):
        own = []
        for level in levels[:-1]:
            own.append(("LR"[(i ^ 1) % 2], level[i ^ 1]) if i ^ 1 < len(level) else None)
            i >>= 1
        paths.append(own)
    return levels[-1][0], paths


def plain_manifest(rows):
    """What op13 returns, of rows (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [plain_paths([leaf(r) for r in groups[g]]) for g in names]
    root, tops = plain_paths([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(names, trees, tops, strict=True):
        for r, path in zip(groups[g], paths, strict=True):
            seven = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4])) if seven else leaf(r)
            for step in path + top:
                h = digest(h) if step is None else digest(step[1], h) if step[0] == "L" else digest(h, step[1])
            out.append((r[0], leaf(r), subroot, root, digest(*(s[1] for s in path + top if s)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("subtree", [1, 2, 3, 4])
def test_the_traversal_gives_every_path(subtree):
    for n in [*range(1, 40), 64, 65, 100, 128]:
        leaves = [digest(str(i)) for i in range(n)]
        root, paths = plain_paths(leaves)
        height = merkle.block_height(n, 12)
        assert merkle.block_root(leaves, height) == root
        assert list(merkle.traverse(leaves, height, subtree)) == [",".join("-" if s is None else "".join(s) for s in p) for p in paths]


def test_the_traversal_holds_a_bounded_number_of_nodes(monkeypatch):
    made, leaves = [], [str(i) for i in range(1024)]
    init = merkle.Subtree.__init__
    monkeypatch.setattr(merkle.Subtree, "__init__", lambda self, *a: (init(self, *a), made.append(self))[0])
    for _ in merkle.traverse(leaves, 10, 2):
        live = {(t.base, t.at): t for t in made[-9:]}.values()
        assert sum(len(level) for t in live for level in t.kept) <= 9 * 2 * 4 and all(len(t.stack) <= 12 for t in live)


DOCS = "doc_id long, source string, lang string, n_chars int, text string"


def some_docs(n):
    langs = [None, "en", "en", "en", "de", "É", "", "z=,-LR"]
    rows = [(i, f"s{i % 5}" if i % 4 else None, langs[i % 8 if i % 3 else 1], i if i % 6 else None, ("text é€ " * (i % 9)) if i % 11 else None) for i in range(n)]
    return [*rows, rows[5], rows[5], (None, None, None, None, None), (None, None, "en", 7, "x"), (5, "other", "en", 1, "y" * 100_000)]


@pytest.mark.parametrize(("n", "bits"), [(300, 2), (300, 12), (30, 3)])
def test_manifest_agrees_with_plain_hashing(spark, monkeypatch, n, bits):
    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda docs, **more: whole(docs, bits=bits, subtree=2, **more))
    rows = some_docs(n)
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("grp", "id", "hash", "own", "pos", "part", "path", "root", "read")})
    got = merkle.tampering(df)
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)
    assert not got.where("not verified").isEmpty()


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(7, "s", "en", 3, "abc")]
    assert list(map(tuple, merkle.tampering(spark.createDataFrame(rows, DOCS)).collect())) == plain_manifest(rows)
    assert merkle.tampering(spark.createDataFrame([], DOCS)).count() == 0


def test_the_new_queries_run_over_the_driver_tables(spark, sf_dir):
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in queries.op11_itq(spark, sf_dir).select("vec_id", "n_links", "component_id", "kept").collect()), key=str) == plain_links(vectors)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries.op13_merkle(spark, sf_dir).collect()), key=str) == plain_manifest(docs)
    assert queries.op12_ball_kmeans(spark, sf_dir).count() == len(vectors)
