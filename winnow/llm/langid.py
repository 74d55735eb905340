"""Language identification by segmentation-marginalised unigrams.

A text's letter runs, in lower case, are cut into pieces of a fixed public vocabulary in every possible way.
Each language has a probability for each piece; a forward algorithm sums the probabilities of all
segmentations of a word, and a text's score for a language is the sum of its words' logarithms and the
language's. Piece probabilities are learned by expectation-maximisation over all words of a bounded
sample: about `per_language` documents of each language outside the held-out fold. The words are a table; a round
is a job over it, whose tasks add up the expected counts of their words, each for the languages that have it, and
send the sums. What reaches the driver is a count for each piece and language, as the model itself is. Every text is
scored whole; a word's scores are kept, so a frequent word is summed over once in each worker.

Null texts, and texts without a letter, are und with score 0, as is every text if no language was learned.
Null languages are not learned from. Languages that score alike go to the first by name. Texts of any length are scored
whole. Repeated rows are each returned, with equal scores, and so are rows whose id is null. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import held_out, materialize, modest_batches, small_slices, tidy
from winnow.llm.tokens import vocabulary

_LETTERS = re.compile(r"[^\W\d_]+")
_LONG = 64
_KEEP = 700_000


def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


def letter_runs(text: str) -> list[str]:
    """Runs of letters, in lower case. Superscripts, fractions and the like are word characters but no letters."""
    words = _LETTERS.findall(text.lower())
    if all(map(str.isalpha, words)):
        return words
    return ["".join(run) for w in words for letters, run in itertools.groupby(w, str.isalpha) if letters]


class Pieces:
    """The vocabulary's pieces as bytes; those with the end mark close a word, the others never do."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        to_byte = _byte_of()
        names = sorted({(p.removesuffix("</w>"), p.endswith("</w>")) for p in vocab if not p.startswith("<|")})
        self.number = {(bytes(to_byte[c] for c in p), end): i for i, (p, end) in enumerate(names) if p}
        self.size, self.longest = len(names), max(len(p) for p, _ in self.number)
        self.tables = []
        for end in (False, True):
            keys = {self._hash(p): i for (p, e), i in self.number.items() if e == end}
            hashes = np.array(sorted(keys), dtype=np.uint64)
            self.tables.append((hashes, np.array([keys[int(h)] for h in hashes], dtype=np.int64)))

    @staticmethod
    def _hash(p: bytes) -> int:
        h = 0
        for b in p:
            h = (h * 0x100000001B3 + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def spans(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For n words of one length (n x length bytes): by (i, j) the piece words[:, i:j], or size for none."""
        n, length = words.shape
        found = {}
        for i in range(length):
            h = np.zeros(n, dtype=np.uint64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = h * np.uint64(0x100000001B3) + words[:, j - 1] + np.uint64(1)
                hashes, numbers = self.tables[j == length]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = hashes[at] == h
                if hit.any():
                    found[i, j] = np.where(hit, numbers[at], self.size)
        return found


@functools.lru_cache(maxsize=2)
def pieces(file: str) -> Pieces:
    return Pieces(file)


def _forward(found: dict, n: int, length: int, p: np.ndarray) -> np.ndarray:
    """n x (length + 1) x languages: the summed probability of all segmentations of each prefix."""
    alpha = np.zeros((length + 1, n, p.shape[1]))
    alpha[0] = 1
    for i in range(length):
        for j in range(i + 1, length + 1):
            if (ids := found.get((i, j))) is not None:
                alpha[j] += alpha[i] * p[ids]
    return alpha


def _long_word(vocab: Pieces, word: bytes, p: np.ndarray) -> np.ndarray:
    """The same sum for one long word, scaled on the way."""
    length, scale = len(word), 0.0
    alpha = {0: np.ones(p.shape[1])}
    for j in range(1, length + 1):
        total = np.zeros(p.shape[1])
        for i in range(max(0, j - vocab.longest), j):
            number = vocab.number.get((word[i:j], j == length))
            if number is not None and i in alpha:
                total = total + alpha[i] * p[number]
        alpha[j] = total
        alpha.pop(j - vocab.longest, None)
        if 0 < total.max() < 1e-100:
            for k in alpha:
                alpha[k] = alpha[k] * 1e100
            scale -= 100 * np.log(10)
    return np.log(np.maximum(alpha[length], 1e-300)) + scale


def word_scores(vocab: Pieces, words: list[bytes], p: np.ndarray) -> np.ndarray:
    """Log-probabilities, words x languages. p has a last row of zeros, for spans that are no piece."""
    out = np.empty((len(words), p.shape[1]), dtype=np.float64)
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for length, rows in by.items():
        if length > _LONG:
            for i in rows:
                out[i] = _long_word(vocab, words[i], p)
            continue
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            chars = np.frombuffer(b"".join(words[i] for i in some), dtype=np.uint8).reshape(-1, length).astype(np.uint64)
            out[some] = np.log(np.maximum(_forward(vocab.spans(chars), len(some), length, p)[length], 1e-300))
    return out


def _long_counts(vocab: Pieces, word: bytes, weight: float, p: np.ndarray, seen: np.ndarray) -> None:
    """Add to seen the expected counts of a long word's pieces, by logarithms."""
    n = len(word)
    spans = [(i, j, number) for j in range(1, n + 1) for i in range(max(0, j - vocab.longest), j) if (number := vocab.number.get((word[i:j], j == n))) is not None]
    logs = {number: math.log(p[number]) for _, _, number in spans}
    ahead, behind = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = behind[n] = 0.0

    def total(terms: list[float]) -> float:
        top = max(terms, default=-math.inf)
        return top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))

    by_end: dict[int, list] = {}
    by_start: dict[int, list] = {}
    for i, j, number in spans:
        by_end.setdefault(j, []).append((i, number))
        by_start.setdefault(i, []).append((j, number))
    for j in range(1, n + 1):
        ahead[j] = total([ahead[i] + logs[number] for i, number in by_end.get(j, ())])
    if ahead[n] == -math.inf:
        return
    for i in range(n - 1, -1, -1):
        behind[i] = total([behind[j] + logs[number] for j, number in by_start.get(i, ())])
    for i, j, number in spans:
        seen[number] += weight * math.exp(ahead[i] + logs[number] + behind[j] - ahead[n])


def expected_counts(vocab: Pieces, words: list[bytes], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the segmentations of the words, under one language's probabilities (the last is that of no piece: 0)."""
    seen = np.zeros(vocab.size + 1)
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for length, rows in by.items():
        if length > _LONG:
            for i in rows:
                _long_counts(vocab, words[i], float(weight[i]), p, seen)
            continue
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            chars = np.frombuffer(b"".join(words[i] for i in some), dtype=np.uint8).reshape(-1, length).astype(np.uint64)
            found = vocab.spans(chars)
            alpha = _forward(found, len(some), length, p[:, None])[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[length] = weight[some] / np.maximum(alpha[length], 1e-300)
            for i in range(length - 1, -1, -1):
                for j in range(i + 1, length + 1):
                    if (ids := found.get((i, j))) is not None:
                        use = p[ids] * beta[j]
                        beta[i] += use
                        seen += np.bincount(ids, use * alpha[i], vocab.size + 1)
    seen[-1] = 0
    return seen


def learn(words: DataFrame, langs: list[str], file: str, rounds: int = 4, smooth: float = 0.02) -> np.ndarray:
    """Piece probabilities, pieces x languages with a last row of zeros, by expectation-maximisation over words (lang, word, n)."""
    size = pieces(file).size
    p = np.full((size + 1, len(langs)), 1 / size)
    p[-1] = 0
    for _ in range(rounds):
        given = words.sparkSession.sparkContext.broadcast(p)

        def each(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            place, sums, vocab = {g: k for k, g in enumerate(langs)}, {}, pieces(file)
            for b in batches:
                own: dict[str, tuple[list, list]] = {}
                for lang, word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    of = own.setdefault(lang, ([], []))
                    of[0].append(word)
                    of[1].append(n)
                for lang, (some, n) in own.items():
                    got = expected_counts(vocab, some, np.array(n, dtype=np.float64), np.ascontiguousarray(given.value[:, place[lang]]))
                    sums[lang] = sums[lang] + got if lang in sums else got
            met = {g: np.flatnonzero(x) for g, x in sums.items()}
            cols = [list(sums), [met[g].astype("<i4").tobytes() for g in sums], [x[met[g]].tobytes() for g, x in sums.items()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "pieces", "counts"])

        def add(key: tuple, t: pa.Table) -> pa.Table:
            total = np.zeros(size + 1)
            for ids, counts in zip(t.column("pieces"), t.column("counts"), strict=True):
                total[np.frombuffer(ids.as_py(), dtype="<i4")] += np.frombuffer(counts.as_py())
            return pa.table({"lang": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

        parts = words.mapInArrow(tidy(each), "lang string, pieces binary, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary")
        seen = np.zeros_like(p)
        for r in parts.toLocalIterator():  # a row a language, of a count a piece
            seen[:, langs.index(r["lang"])] = np.frombuffer(bytes(r["counts"]))
        given.destroy()
        seen = seen[:-1] + smooth
        p[:-1] = seen / seen.sum(axis=0)
    return p


def sample_words(docs: DataFrame, per_language: int) -> tuple[dict[str, int], DataFrame | None]:
    """(documents of each language, a table of the words of each language's sample: lang, word in UTF-8, n)."""
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return {}, None
    share = spark.createDataFrame([(g, min(1.0, per_language / n)) for g, n in sorted(sizes.items())], "lang string, share double")
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(F.broadcast(share), "lang").where((lot < F.col("share")) & F.col("text").isNotNull()).select("lang", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, n in Counter(letter_runs(text)).items():
                    seen[lang, w.encode("utf-8", "surrogatepass")] += n
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in seen], pa.string()), pa.array([w for _, w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    total = some.mapInArrow(tidy(each), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    tasks = min(32, int(spark.conf.get("spark.sql.shuffle.partitions")))  # the sample is bounded, and a round is a job
    return sizes, materialize(total.repartition(tasks, "word"), "words")


class _Known:
    """A worker's scores of the words it has met."""

    def __init__(self, vocab: Pieces, p: np.ndarray):
        self.vocab, self.p, self.row, self.scores, self.used = vocab, p, {}, np.empty((1 << 12, p.shape[1])), 0

    def rows(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.row]
        if len(self.row) + len(new) > _KEEP:
            self.row.clear()
            self.used, new = 0, list(dict.fromkeys(words))
        if not new:
            return
        got = word_scores(self.vocab, [w.encode("utf-8", "surrogatepass") for w in new], self.p)
        while self.used + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        self.scores[self.used : self.used + len(new)] = got
        self.row.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)


_known: dict[str, _Known] = {}


def predict_language(docs: DataFrame, file: str | None = None, per_language: int = 400) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the language's share of the posterior)."""
    file = file or vocabulary()
    sizes, words = sample_words(docs, per_language)
    langs = sorted(sizes)
    p = learn(words, langs, file) if langs else np.zeros((1, 0))
    prior = np.log([sizes[g] / sum(sizes.values()) for g in langs]) if langs else np.zeros(0)
    given = docs.sparkSession.sparkContext.broadcast((langs, p, prior))  # languages x vocabulary
    name = uuid.uuid4().hex  # of this model, in the workers

    def one(found: list[str], known: _Known, prior: np.ndarray) -> tuple[int, float]:
        total = prior + known.scores[np.fromiter(map(known.row.__getitem__, found), dtype=np.int64, count=len(found))].sum(axis=0)
        best = int(np.argmax(total))
        return best, float(1 / np.exp(total - total[best]).sum())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p, prior = given.value
        if name not in _known:
            _known.clear()
            _known[name] = _Known(pieces(file), p)
        known = _known[name]
        for whole in batches:
            for b in small_slices(whole, 1):
                lang, score = [], []
                lists = [letter_runs(t) if t and langs else [] for t in b.column(1).to_pylist()]
                known.rows([w for ws in lists for w in ws])
                for ws in lists:
                    best, s = one(ws, known, prior) if ws else (None, 0.0)
                    lang.append("und" if best is None else langs[best])
                    score.append(s)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return modest_batches(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(each, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
