"""Secret scans: fixed patterns, and a battery of randomness tests over other token-like runs.

A run of key characters may hold more than a key: its name, a path, signs between. So each of its maximal parts of 20 or
more characters of one alphabet (hexadecimal, base32, base36, base62, base64, base64url; with padding) is a candidate, under
the smallest encoding that holds it; letters of one case are words and no candidates. Three tests ask whether
it was drawn at random from that alphabet: chi-squared uniformity, runs of character classes, and serial
correlation; their p-values are combined by the Cauchy rule. How often an ordinary string of that encoding
and length looks as random is known from simulation (`ordinary`: letters as frequent as in prose, small
digits first, classes that last). That share is the p-value of the run as a secret, and Benjamini and
Hochberg's rule over all runs of an encoding and length, in all documents, sets the least combined p-value
from which they are taken for secrets: a run alone is judged like one of many, and short runs, on which the
tests have little power, need more. All candidates are counted, parts of others too; those taken that overlap are one
span. Only the histogram of combined p-values reaches the driver.

Null texts count as empty, and stay null when texts are redacted. Texts of any length are scanned whole.
Offsets are code points, end exclusive. Repeated rows are each returned. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import materialize, modest_batches, small_slices, text_of, tidy

KINDS = ("assign", "access", "hex", "random")
#: The base patterns and the least length of what they must match (group 2 for assign).
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
_RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
_LEAST_RUN = 20
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_BINS = 200
LEVEL = 0.05
_IN_RUN = np.zeros(256, dtype=bool)
_IN_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet to the largest.
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "hex_upper": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "base36_upper": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}


def _has_long_run(text: str) -> bool:
    """Whether 20 ASCII key characters follow one another; without, no pattern but assign can hold."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    outside = np.flatnonzero(~_IN_RUN[raw])
    if not len(outside):
        return len(raw) >= _LEAST_RUN
    return max(outside[0], len(raw) - 1 - outside[-1], int(np.diff(outside).max(initial=0)) - 1) >= _LEAST_RUN


def base_spans(text: str, long_run: bool | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, in order."""
    long_run = _has_long_run(text) if long_run is None else long_run
    low = text.lower()
    named = any(w in low for w in _WORDS)
    out = []
    for k, (pattern, group, least) in enumerate(PATTERNS.values()):
        if long_run if k else named:
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def encoding_of(token: str) -> str | None:
    """The smallest encoding whose alphabet holds the token without its padding; None for plain words and numbers."""
    body = token.rstrip("=")
    if len(body) < _LEAST_RUN or body.isdigit() or body[1:].isalpha() and (body[1:].islower() or body.isupper()):
        return None
    used = set(body)
    return next((name for name, alphabet in ALPHABETS.items() if used <= set(alphabet)), None)


_erfc = np.vectorize(math.erfc, otypes=[float])


def _battery(x: np.ndarray, encoding: str) -> np.ndarray:
    """(p of chi-squared, runs, serial correlation, combined) for each row of letters' places in the alphabet."""
    alphabet = ALPHABETS[encoding]
    (rows, n), k = x.shape, len(alphabet)
    counts = np.zeros((rows, k))
    np.add.at(counts, (np.arange(rows)[:, None], x), 1)
    chi = (counts**2).sum(axis=1) * k / n - n
    d = k - 1  # Wilson and Hilferty's normal approximation, upper tail
    z = (np.cbrt(chi / d) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    p_chi = 0.5 * _erfc(z / math.sqrt(2))
    kinds = np.array([0 if c in _DIGITS else 1 if c in _LOWER else 2 if c in _UPPER else 3 for c in alphabet])
    share = np.bincount(kinds) / k
    two, three = (share**2).sum(), (share**3).sum()
    change = 1 - two
    own = kinds[x]
    seen = (own[:, 1:] != own[:, :-1]).sum(axis=1)
    var = (n - 1) * change * (1 - change) + 2 * (n - 2) * (1 - 2 * two + three - change * change)
    p_runs = _erfc(np.abs(seen - (n - 1) * change) / math.sqrt(2 * var))
    away = x - x.mean(axis=1, keepdims=True)
    spread = (away**2).sum(axis=1)
    r = np.where(spread > 0, (away[:, 1:] * away[:, :-1]).sum(axis=1) / np.maximum(spread, 1e-300), 1.0)
    p_serial = _erfc(np.abs(r + 1 / n) * math.sqrt(n / 2))
    each = np.clip(np.stack([p_chi, p_runs, p_serial]), 1e-12, 0.99)
    combined = 0.5 - np.arctan(np.tan((0.5 - each) * math.pi).mean(axis=0)) / math.pi
    return np.stack([p_chi, p_runs, p_serial, combined], axis=1)


def randomness(token: str, encoding: str) -> tuple[float, float, float, float]:
    """p-values of the token as random in its encoding: chi-squared, runs, serial correlation, combined."""
    place = {c: i for i, c in enumerate(ALPHABETS[encoding])}
    return tuple(_battery(np.array([[place[c] for c in token.rstrip("=")]]), encoding)[0].tolist())


#: Letters from the most to the least frequent in prose.
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


@functools.cache
def ordinary(encoding: str, length: int, rows: int = 4000) -> list[np.ndarray]:
    """Sorted combined p-values of simulated strings that were not drawn at random, in two families: a class of letters
    is kept six times in seven; and, where there are both cases, words of some five letters each begin with a capital,
    a digit or a sign. Letters come as often as in prose: weights fall with the rank, and for digits from 0 up."""
    alphabet = ALPHABETS[encoding]
    rng = np.random.default_rng([length, *encoding.encode()])
    groups = [g for g in ([c for c in alphabet if c in _DIGITS], [c for c in alphabet if c in _LOWER], [c for c in alphabet if c in _UPPER], [c for c in alphabet if not c.isalnum()]) if g]
    size = np.array([len(g) if g[0].isalnum() else 1 for g in groups], dtype=float)

    def judged(kind: np.ndarray) -> np.ndarray:
        x = np.zeros((rows, length), dtype=np.int64)
        for i, g in enumerate(groups):
            rank = np.array([_FREQUENT.index(c.lower()) if c.isalpha() else int(c) if c.isdigit() else 0 for c in g], dtype=float)
            weight = 1 / (rank + 2)
            here = kind == i
            x[here] = rng.choice([alphabet.index(c) for c in g], int(here.sum()), p=weight / weight.sum())
        return np.sort(_battery(x, encoding)[:, 3])

    change = rng.random((rows, length)) < 1 / 7
    change[:, 0] = True
    drawn = rng.choice(len(groups), (rows, length), p=size / size.sum())
    families = [judged(np.take_along_axis(drawn, np.maximum.accumulate(np.where(change, np.arange(length), 0), axis=1), axis=1))]
    lower, upper = ([i for i, g in enumerate(groups) if g[0] in letters] for letters in (_LOWER, _UPPER))
    if lower and upper:
        first = rng.random((rows, length)) < 1 / 5
        opener = np.where(rng.random((rows, length)) < 0.7, upper[0], rng.choice([i for i in range(len(groups)) if i not in lower], (rows, length)))
        families.append(judged(np.where(first, opener, lower[0])))
    return families


#: Of each alphabet, its maximal parts that are long enough.
_PARTS = [re.compile(f"[{re.escape(alphabet)}]{{{_LEAST_RUN},}}") for alphabet in ALPHABETS.values()]
_PADDING = re.compile(r"={1,2}(?![A-Za-z0-9+/_=-])")


def parts_of(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, encoding) of the parts of a run that may be keys by themselves, in order; padding belongs to a part."""
    found = {}
    for pattern in _PARTS:
        for m in pattern.finditer(text, start, end):
            if m.span() not in found and (enc := encoding_of(m.group())):
                found[m.span()] = enc
    return sorted((s, p.end() if (p := _PADDING.match(text, e)) else e, enc) for (s, e), enc in found.items())


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, float]]:
    """(start, end, stratum, p) of parts of runs that no base span touches; the stratum is the encoding and the length's power of two."""
    if not _has_long_run(text):
        return []
    out, starts = [], [s for s, _, _ in taken]  # in order
    furthest = list(itertools.accumulate((e for _, _, e in taken), max))
    for m in _RUN.finditer(text):
        if m.end() - m.start() < _LEAST_RUN:
            continue
        for start, end, enc in parts_of(text, m.start(), m.end()):
            before = bisect.bisect_left(starts, end)  # spans that start before the part's end
            if not (before and furthest[before - 1] > start):
                out.append((start, end, f"{enc}/{min(20, (end - start).bit_length())}", randomness(text[start:end], enc)[3]))
    return out


_SCAN = "doc_id {kind}, base array<struct<start:long,kind:int,end:long>>, runs array<struct<start:long,end:long,stratum:string,p:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base spans, and the candidate runs with their stratum and p-value."""
    schema = _SCAN.format(kind=docs.schema[id_col].dataType.simpleString())
    base_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.string()), ("p", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, runs = [], []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                base.append(spans := base_spans(text))
                runs.append(candidates(text, spans))
            named = lambda rows, names: [[dict(zip(names, x, strict=True)) for x in r] for r in rows]
            cols = [b.column(0), pa.array(named(base, ("start", "kind", "end")), base_type), pa.array(named(runs, ("start", "end", "stratum", "p")), run_type)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "base", "runs"])

    return modest_batches(docs).select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(tidy(each), schema)


def thresholds(scanned: DataFrame, rate: float = 0.1) -> dict[str, float]:
    """For each stratum the least combined p-value from which runs count as secrets, or 2 where none do.

    Of the runs from a value on, at most `rate` are expected to be ordinary strings: the share of simulated ones from
    there on (in the family where it is larger, at the stratum's least length, where they look random most often), times
    all runs of the stratum. Runs that the battery rejects at LEVEL count in no case.
    """
    runs = scanned.select(F.explode("runs").alias("r"))
    bins = runs.groupBy(F.col("r.stratum").alias("stratum"), F.least(F.floor(F.col("r.p") * _BINS), F.lit(_BINS - 1)).cast("int").alias("bin")).count()
    by: dict[str, np.ndarray] = {}
    for r in bins.collect():  # encodings x lengths x bins at most
        by.setdefault(r["stratum"], np.zeros(_BINS))[r["bin"]] += r["count"]

    def least(stratum: str) -> float:
        encoding, _, bits = stratum.partition("/")
        null = ordinary(encoding, max(_LEAST_RUN, 1 << (min(int(bits), 11) - 1)))
        above = np.cumsum(by[stratum][::-1])[::-1]
        for k in range(round(LEVEL * _BINS), _BINS):
            share = max((1 + len(x) - np.searchsorted(x, k / _BINS)) / (1 + len(x)) for x in null)
            if above[k] and share * above[0] <= rate * above[k]:
                return k / _BINS
        return 2.0

    return {s: least(s) for s in by}


def find_secrets(docs: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base and spans (arrays of start, kind's number in KINDS, end), by start and kind."""
    scanned = materialize(scan(docs, id_col, text_col), "secrets")
    return _decide(scanned, thresholds(scanned, rate))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _decide(scanned: DataFrame, limits: dict[str, float]) -> DataFrame:
    kind, schema = KINDS.index("random"), scanned.schema["base"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [joined([(r["start"], r["end"]) for r in runs if r["p"] >= limits.get(r["stratum"], 2.0)]) if runs else [] for runs in b.column(2).to_pylist()]
            found = [[{"start": s, "kind": kind, "end": e} for s, e in spans] for spans in kept]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, b.column(1).type)], ["doc_id", "base", "random"])

    found = scanned.mapInArrow(each, f"doc_id {scanned.schema['doc_id'].dataType.simpleString()}, base {schema}, random {schema}")
    return found.select("doc_id", "base", F.array_sort(F.concat("base", "random")).alias("spans"))


def redact(docs: DataFrame, rate: float = 0.1, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every secret's characters replaced by the mask; n_chars, if there, follows. No row goes."""
    limits = thresholds(scan(docs, id_col, text_col), rate)
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = sorted([(s, e) for s, _, e in base] + [(s, e) for s, e, stratum, p in candidates(text, base) if p >= limits.get(stratum, 2.0)])
        out, done = [], 0
        for s, e in spans:
            if s >= done:
                out += [text[done:s], mask]
            done = max(done, e)
        return "".join([*out, text[done:]]) if spans else text

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_slices(whole, at, 4 << 20):
                yield b.set_column(at, text_col, pa.array([clean(b.column(at)[i].as_py()) for i in range(b.num_rows)], pa.string()))

    out = modest_batches(docs).mapInArrow(tidy(each), docs.schema)
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_chars").isNotNull(), F.length(text_col)).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", n)
    return out
