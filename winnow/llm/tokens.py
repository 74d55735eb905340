"""Ids of a public word-level BPE vocabulary, exactly as the tokenizers library gives them.

The vocabulary splits a normalised text into pieces (letter runs, single digits, punctuation runs,
clitics) and encodes each on its own, so a piece's ids can be kept and reused. Texts made only of
characters for which Python's lower-casing and classes are known to agree with the library's take
this path; any other text, or one that may hold a special token's string, goes to the library whole.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np

#: Tab, line ends, printable ASCII, Latin-1 and Latin Extended-A letters and signs, common dashes and
#: quotes: all are NFC, none lower-cases by context. U+0130 (two characters in lower case) and U+0149 stay out.
_PLAIN = "\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž–—‘’“”…€"
_OTHER = re.compile(f"[^{_PLAIN}]")


def _pieces() -> re.Pattern:
    plain = [c for c in map(chr, range(0x2100)) if not _OTHER.match(c)]
    letters = "".join(c for c in plain if unicodedata.category(c)[0] == "L")
    numbers = "".join(c for c in plain if unicodedata.category(c)[0] == "N")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")


_PIECES = _pieces()
_SPACE = re.compile(r"[\t\n\r ]")
_STEP = 1 << 20


class PieceEncoder:
    """Encodes texts to little-endian uint32 ids; keeps the ids of at most `keep` pieces."""

    def __init__(self, file: str, keep: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.keep = keep
        self.ids: dict[str, bytes] = {}
        vocab = self.library.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _known(self, pieces: list[str]) -> bytes:
        ids = self.ids
        try:
            return b"".join(map(ids.__getitem__, pieces))
        except KeyError:
            pass
        new = [p for p in set(pieces) if p not in ids]
        if len(ids) + len(new) > self.keep:
            ids.clear()
            new = list(set(pieces))
        # pieces apart by a space are split as they are; an id that closes a word ends each
        found = np.array(self.library.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[found]) + 1
        if len(ends) != len(new):
            raise ValueError("the vocabulary does not end each piece with a closing id")
        raw = found.tobytes()
        ends = (4 * ends).tolist()
        for p, at, end in zip(new, [0, *ends], ends):
            ids[p] = raw[at:end]
        return b"".join(map(ids.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        if "<|" in text or _OTHER.search(text):
            return self._whole(text)
        if len(text) <= _STEP:
            return self._known(_PIECES.findall(text.lower()))
        out, at = [], 0
        while at < len(text):  # white space is part of no piece: cut there
            cut = _SPACE.search(text, at + _STEP)
            end = cut.start() if cut else len(text)
            out.append(self._known(_PIECES.findall(text[at:end].lower())))
            at = end
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(file: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary; workers are reused between tasks."""
    return PieceEncoder(file)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
