"""Main-text extraction with the repeated word runs of each host.

A page's markup is cut into blocks of words, each in a zone: inside an article or main element, in a part
whose element or class names it (menus, headers, footers, sidebars, notices, adverts, forms, comments), or
in neither. A substring of `depth` words or more, or a whole block of fewer, on three or more distinct pages
of a host, most of whose occurrences lie outside articles, is boilerplate, and every word it covers is
removed, but not from an article's prose: what an article quotes, or a sentence that others advertise, is its
own. A block that is mostly covered, and keeps less than a run of its own, goes whole. Parts that only a class, id
or role names are left out, unless the page has no other text: then repeats decide on them. Blocks of an article
that are mostly links count as outside it. What remains of the article's blocks is the text. If the page has
no article, repeats decide on all its unnamed blocks, and neighbours that are mostly links are a menu.

Of the suffixes of a host's word streams only the first `depth` words matter: substrings that repeat are
classes of suffixes that agree so far. In one group of pages (`extract_group`) these are sorted; over a table
(`extract`) a class is a 64-bit hash of the host and the words, and is counted over the whole host, whatever
its size:

* the pages that repeats can't change are done after one scan; the others wait in chunks of `group_bytes`,
  and what runs they need judged is noted by chunk;
* where any wait, a second scan counts those runs on all pages. A chunk names at most `PAGES` pages of a
  run, which is enough to tell whether the host has so many, so a run of every page is a few rows a chunk;
* the runs found bad are joined back to the chunks that asked for them.

Runs that were not asked for are mostly kept out of the count by a bit map of `1 << FILTER_BITS` bits, which
is the proven bound of what reaches the driver; those that pass it are judged in vain.

Null html counts as empty and gives an empty text; null urls are one host. Repeated rows are one distinct
page and are each returned; ids may repeat or be null. Pages of any length are parsed whole. An empty table
gives no rows.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import materialize, modest_batches, small_slices, text_of, tidy

#: HINTED is in a part that only a class, id or role names, which may be wrong.
ARTICLE, NAMED, OTHER, HINTED = 0, 1, 2, 3
#: On so many distinct pages of a host a run is repeated.
PAGES = 3
FILTER_BITS = 22
#: A quote opens a string only where an attribute's value begins, and if it is closed again; any other is a character like others.
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*)((?>=[\t\n\f\r\x20]*(?>"[^"]*"|'[^']*'|(?!["'])[^\t\n\f\r\x20>]*)|[^>])*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"(?:^|[\s/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "noscript", "svg", "math", "object", "canvas", "select", "audio", "video"}
_DROP = {"nav", "footer", "aside", "form", "head", "button", "header", "menu", "dialog", "fieldset", "datalist", "label"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words of a class, id or role that name a part which is not the article.
_PARTS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager "
    "footer foot sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus masthead contentinfo complementary search toolbar skip copyright legal disclaimer outbrain taboola".split()
)
_HEADER = {"header"}
#: Beside a part's name these say that a container has or lacks the part, not that it is one.
_ABOUT = {"with", "without", "has", "no"}
#: An article element of one of these classes is a comment or teaser in another's page.
_MINOR = {"ad", "ads", "advert", "comment", "comments", "reply", "promo", "related", "recommended", "sponsored"}


def _named_part(tag: str, attrs: str, in_article: bool) -> int | None:
    """The zone of a part that its element or its classes name; None if they don't."""
    if tag in _DROP and not (tag == "header" and in_article):
        return NAMED
    if tag in _DROP:
        return None
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return NAMED
        words = set(_NAME.findall(_CAMEL.sub(" ", value).lower()))
        parts = _MINOR if tag in ("article", "main") else _PARTS if in_article else _PARTS | _HEADER
        if words & parts and not words & _ABOUT:
            return HINTED
    return None


def blocks_of(page: str) -> list[tuple[int, list[str], bool]]:
    """(zone, words, whether links hold most of its text) of each block with text, in page order."""
    out: list[tuple[int, list[str], bool]] = []
    text: list[str] = []
    linked, in_link = 0, False
    stack: list[tuple[str, int]] = []  # open elements that set a zone
    zone, at, n = OTHER, 0, len(page)

    def close() -> None:
        nonlocal linked
        if text and (words := html_lib.unescape(whole := "".join(text)).split()):
            out.append((zone, words, 2 * linked > len(whole)))
        text.clear()
        linked = 0

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        linked += in_link * (m.start() - at)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = not m[1]
        if m[1]:
            if tag not in _INLINE:
                close()
            elif tag == "br":
                text.append(" ")
            if any(t == tag for t, _ in stack):
                close()
                while stack.pop()[0] != tag:
                    pass
                zone = stack[-1][1] if stack else OTHER
            continue
        if tag in _RAW:
            if tag not in _INLINE:
                close()
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            if m[0].endswith("/>") and tag in ("svg", "math"):
                continue
            if end is None:
                at = n
            else:
                stop = page.find(">", end.end())
                at = stop + 1 if stop >= 0 else n
            continue
        if tag == "br":
            text.append(" ")
        elif tag not in _INLINE:
            close()
        if tag == "body" and any(t == "head" for t, _ in stack):  # a head that was not closed
            stack.clear()
            zone = OTHER
        if tag in _VOID:
            continue
        inside = any(z == ARTICLE for _, z in stack)
        named = _named_part(tag, m[3] or "", inside) if zone != NAMED and tag not in ("html", "body") else None
        if zone == NAMED or zone == HINTED and named != NAMED:
            if any(t == tag for t, _ in stack) or tag in ("article", "main"):
                stack.append((tag, zone))  # a child of that name closes first
        elif named is not None:
            close()
            stack.append((tag, named))
            zone = named
        elif tag in ("article", "main") or any(t == tag for t, _ in stack):
            new = ARTICLE if tag in ("article", "main") else zone
            close()
            stack.append((tag, new))
            zone = new
    close()
    return out


def repeated(tokens: np.ndarray, page: np.ndarray, outside: np.ndarray, depth: int, pages: int = PAGES) -> np.ndarray:
    """Which tokens a boilerplate substring covers: the suffixes are sorted by their first 1, 2, 4, ... words up
    to depth (a power of two), those that are alone falling out; then each class of equal ones is judged."""
    n = len(tokens)
    rank, alive, size = tokens.astype(np.int64), np.arange(n), 1
    covered = np.zeros(n, dtype=bool)
    while size < depth and len(alive):
        alive = alive[alive + size < n]
        key = rank[alive] * (n + int(tokens.max(initial=0)) + 1) + rank[alive + size]
        order = np.argsort(key, kind="stable")  # this round's part of the suffix array
        ordered = key[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, bool)
        klass = np.cumsum(fresh) - 1
        many = np.bincount(klass)[klass] > 1 if len(klass) else np.empty(0, bool)
        rank = np.full(n, -1, dtype=np.int64)
        alive = alive[order][many]
        rank[alive] = klass[many] + 1
        size *= 2
        # a suffix whose continuation stood alone can equal no other
        alive = alive[rank[np.minimum(alive + size, n - 1)] >= 0] if size < depth else alive
    if not len(alive):
        return covered
    klass = rank[alive]
    order = np.lexsort((page[alive], klass))
    alive, klass = alive[order], klass[order]
    first = np.concatenate([[True], (klass[1:] != klass[:-1]) | (page[alive][1:] != page[alive][:-1])])
    width = int(klass.max()) + 1
    total, apart = np.bincount(klass, minlength=width), np.bincount(klass, outside[alive], minlength=width)
    bad = (np.bincount(klass, first, minlength=width) >= pages) & (2 * apart > total)
    edge = np.zeros(n + depth + 1, dtype=np.int64)
    hits = alive[bad[klass]]
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + depth, -1)
    return np.cumsum(edge)[:n] > 0


def uncovered(words: list[str], covered: np.ndarray, depth: int) -> list[str]:
    """The words of a block without its covered runs; a run that only reaches into the block by a few words stays. The
    whole block goes where repeats cover most of it and leave less than a run."""
    if not covered.any() or covered.all():
        return [] if covered.all() else words
    out, at = [], 0
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist()
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= depth:
            out += words[at:a]
            at = b
    out += words[at:]
    return [] if len(out) < depth and 2 * len(out) < len(words) else out


def _wanted(blocks: list[tuple[int, list[str], bool]]) -> int:
    """The zone of the page's text: parts that only classes name hold it where nothing else does."""
    zones = {z for z, _, _ in blocks}
    return ARTICLE if ARTICLE in zones else OTHER if OTHER in zones or HINTED not in zones else HINTED


def _open(zone: int, linked: bool, wanted: int) -> bool:
    """Whether repeats decide on a block."""
    return zone == wanted and (zone != ARTICLE or linked)


def _text(blocks: list[tuple[int, list[str], bool]], covered: np.ndarray | None, depth: int) -> str:
    """The page's main text, covered being by word and block end; without it if repeats decide on no block."""
    wanted, lines, at = _wanted(blocks), [], 0
    # without an article, neighbours that are mostly links are a menu, whatever they are called
    menu = [wanted != ARTICLE and any(0 <= i < len(blocks) and blocks[k][2] and blocks[i][2] for i in (k - 1, k + 1)) for k in range(len(blocks))]
    for (zone, words, linked), skip in zip(blocks, menu, strict=True):
        if zone == wanted and not skip and (kept := uncovered(words, covered[at : at + len(words)], depth) if _open(zone, linked, wanted) else words):
            lines.append(" ".join(kept))
        at += len(words) + 1
    return "\n".join(lines)


def extract_group(pages: list[str], depth: int) -> list[str]:
    """The main texts of the pages of a host that fits in memory."""
    parsed = [blocks_of(p) for p in pages]
    numbers: dict[str, int] = {}
    stream, page_of, outside, seen = [], [], [], {}
    for k, blocks in enumerate(parsed):
        whole = tuple((z, tuple(w)) for z, w, _ in blocks)
        distinct = seen.setdefault(hash(whole), k)  # equal pages count as one
        for zone, words, linked in blocks:
            stream += [numbers.setdefault(w, len(numbers) + 2) for w in words]
            stream.append(1)  # the end of a block
            page_of += [distinct] * (len(words) + 1)
            outside += [zone != ARTICLE or linked] * (len(words) + 1)
        stream.append(-k - 1)  # the end of a page equals no other word
        page_of.append(distinct)
        outside.append(False)
    tokens = np.array(stream, dtype=np.int64)
    tokens[tokens < 0] = len(numbers) + 1 - tokens[tokens < 0]
    covered = repeated(tokens, np.array(page_of), np.array(outside, dtype=np.float64), depth)
    short: dict[tuple, list[tuple[int, bool, int]]] = {}  # blocks of less than a run: (page, outside, place)
    at = 0
    for k, blocks in enumerate(parsed):
        for _, words, _ in blocks:
            if len(words) < depth:
                short.setdefault(tuple(words), []).append((page_of[at], bool(outside[at]), at))
            at += len(words) + 1
        at += 1
    for words, met in short.items():
        if len({page for page, _, _ in met}) >= PAGES and 2 * sum(apart for _, apart, _ in met) > len(met):
            for _, _, place in met:
                covered[place : place + len(words)] = True
    out, at = [], 0
    for blocks in parsed:
        n = sum(len(words) + 1 for _, words, _ in blocks)
        out.append(_text(blocks, covered[at : at + n], depth))
        at += n + 1
    return out


def _hashed(seed: int, words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    n = max(0, len(words) - width + 1)
    runs = np.full(n, seed & (1 << 64) - 1, dtype=np.uint64)
    for k in range(width):
        runs = (runs ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    return runs


def page_runs(blocks: list[tuple[int, list[str], bool]], host: int, depth: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each run of depth words and block ends, and of each whole block of fewer words: hash, (place, length), whether
    it starts outside articles, whether it reaches into a block on which repeats decide; and the hash of the page.
    known keeps the hashes of words."""
    stream, outside, ours, short, wanted = [], [], [], [], _wanted(blocks)
    for zone, words, linked in blocks:
        if len(words) < depth:
            short.append((len(stream), len(words)))
        for w in words:
            if (h := known.get(w)) is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 7)
            stream.append(h)
        stream.append(1)
        outside += [zone != ARTICLE or linked] * (len(words) + 1)
        ours += [_open(zone, linked, wanted)] * len(words) + [False]
    tokens = np.array(stream, dtype=np.uint64)
    page = xxhash.xxh64_intdigest(tokens.tobytes() + bytes(z for z, _, _ in blocks)) >> 1
    runs, mine = _hashed(host, tokens, depth), np.array(ours, dtype=bool)
    n = len(runs)
    reach = np.zeros(n, dtype=bool)
    for k in range(depth):
        reach |= mine[k : k + n]
    whole = [int(_hashed(host ^ 0x5BD1E995, tokens[a : a + size], size)[0]) for a, size in short]
    first = np.array([a for a, _ in short], dtype=np.int64)
    spans = np.stack([np.append(np.arange(n), first), np.append(np.full(n, depth), np.array([size for _, size in short], dtype=np.int64))])
    apart = np.array(outside, dtype=bool)
    return np.append(runs, np.array(whole, dtype=np.uint64)).view(np.int64), spans, np.append(apart[:n], apart[first]), np.append(reach, mine[first]), page


def _counts(host: np.ndarray, run: np.ndarray, page: np.ndarray, apart: np.ndarray) -> list[np.ndarray]:
    """host, run, page, occurrences, those outside articles: per run of a host a row for each of PAGES pages at most,
    the first of which has the counts of all."""
    order = np.lexsort((page, run, host))
    host, run, page, apart = host[order], run[order], page[order], apart[order]
    fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (host[1:] != host[:-1])])
    first = fresh | np.concatenate([[True], page[1:] != page[:-1]])
    klass = np.cumsum(fresh) - 1
    nth = np.cumsum(first)
    kept = first & (nth - nth[fresh][klass] < PAGES)
    n, out = np.bincount(klass), np.bincount(klass, apart).astype(np.int64)
    return [host[kept], run[kept], page[kept], np.where(fresh, n[klass], 0)[kept], np.where(fresh, out[klass], 0)[kept]]


def _bit_map(values: DataFrame, column: str) -> np.ndarray:
    """Which low FILTER_BITS of the column occur."""
    low = values.select(F.col(column).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).cast("int").alias("b")).distinct().toArrow()
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[low.column("b").to_numpy()] = True
    return np.packbits(bits)


def _passes(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & ((1 << FILTER_BITS) - 1)
    return (bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1).astype(bool)


def extract(pages: DataFrame, depth: int = 8, group_bytes: int = 1 << 20) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = modest_batches(pages).select("page_id", "url", text_of("html").alias("html"), F.xxhash64(host).alias("host"))
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    result = f"page_id {id_type}, url {url_type}, text string, n_chars long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for whole in batches:
            for b in small_slices(whole, 2, group_bytes):
                html, hosts, texts, waiting, asked = b.column(2).to_pylist(), b.column(3).to_pylist(), [], [], []
                known: dict[str, int] = {}
                for page, h in zip(html, hosts, strict=True):
                    blocks = blocks_of(page)
                    wanted = _wanted(blocks)
                    if waits := any(_open(z, linked, wanted) for z, _, linked in blocks):
                        runs, _, _, reach, _ = page_runs(blocks, h, depth, known)
                        asked.append(np.unique(runs[reach]))
                    texts.append(None if waits else _text(blocks, None, depth))
                    waiting.append(page if waits else None)
                runs = np.unique(np.concatenate(asked)) if asked else np.empty(0, np.int64)
                needs = pa.array([runs if k == 0 and asked else None for k in range(b.num_rows)], pa.list_(pa.int64()))
                n = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), n, pa.array(waiting, pa.string()), b.column(3), pa.array([chunk] * b.num_rows, pa.int64()), needs]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "html", "host", "chunk", "asked"])
                chunk += 1

    scanned = materialize(rows.mapInArrow(tidy(scan), f"{result}, html string, host long, chunk long, asked array<long>"), "scanned")
    done, waiting = scanned.where("html is null").select("page_id", "url", "text", "n_chars"), scanned.where("html is not null")
    if waiting.isEmpty():
        return done
    asked = scanned.where("asked is not null").select("chunk", F.explode("asked").alias("run"))
    asked_hosts, asked_runs = _bit_map(waiting, "host"), _bit_map(asked, "run")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in small_slices(whole, 0, group_bytes):
                known: dict[str, int] = {}
                parts = []
                hosts = b.column(1).to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(_passes(asked_hosts, hosts)).tolist():
                    runs, _, outside, _, page = page_runs(blocks_of(b.column(0)[k].as_py()), int(hosts[k]), depth, known)
                    sought = _passes(asked_runs, runs)
                    if sought.any():
                        n = int(sought.sum())
                        parts.append((np.full(n, hosts[k]), runs[sought], np.full(n, page, dtype=np.int64), outside[sought]))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _counts(*map(np.concatenate, zip(*parts, strict=True)))], ["host", "run", "page", "n", "apart"])

    counted = rows.select("html", "host").mapInArrow(tidy(count), "host long, run long, page long, n long, apart long").repartition("host", "run")
    by_page = counted.groupBy("host", "run", "page").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"))
    judged = by_page.groupBy("host", "run").agg(F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("apart").alias("apart"))
    bad = judged.where((F.col("pages") >= PAGES) & (2 * F.col("apart") > F.col("n"))).select("run")
    found = asked.join(bad, "run", "left_semi").select(F.col("chunk").alias("at"), "run")

    def finish(chunk: pa.Table, bad: pa.Table) -> pa.Table:
        runs_of, known, texts = np.unique(bad.column("run").to_numpy()), {}, []
        for page, h in zip(chunk.column("html").to_pylist(), chunk.column("host").to_pylist(), strict=True):
            blocks = blocks_of(page)
            runs, spans = page_runs(blocks, h, depth, known)[:2]
            edge = np.zeros(sum(len(w) + 1 for _, w, _ in blocks) + depth + 1, dtype=np.int64)
            hits = np.flatnonzero(np.isin(runs, runs_of))
            np.add.at(edge, spans[0][hits], 1)
            np.add.at(edge, spans[0][hits] + spans[1][hits], -1)
            texts.append(_text(blocks, np.cumsum(edge) > 0, depth))
        return pa.table({"page_id": chunk.column("page_id"), "url": chunk.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    chunks = waiting.select("page_id", "url", "html", "host", "chunk").groupBy("chunk")
    return done.unionByName(chunks.cogroup(found.groupBy("at")).applyInArrow(finish, result))
