"""Text functions. What Spark's expressions can do is done in the JVM; HTML, Unicode normal forms and case folding are
Arrow-batched, and values without markup, references or characters beyond ASCII pass them by. Columns are named once
in each expression, so that functions may be nested."""

from __future__ import annotations

import html
import ipaddress
import re
import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from winnow.functions import fixed


def _series(fn):
    """A pandas UDF that applies fn to each value; null stays null."""

    @F.pandas_udf(StringType())
    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else fn(v))

    return each


# --- markup ---------------------------------------------------------------------------------------

#: A comment, declaration, element or what of one is left at the end of the text.
#: A quote opens a string only where an attribute's value begins; any other is a character like others. End tags have no values.
_ANY_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</(?:[a-z][^>]*)?(?:>|\Z)|<\Z
    |<[a-z](?>=[\t\n\f\r\x20]*(?>"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|(?!["'])[^\t\n\f\r\x20>]*)|[^>=])*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
_MATH_TAG = re.compile(fixed.MARKUP, re.I)
_BREAK = re.compile(r"<(?:/?(?:[^\s/>]*:)?(?:p|title)|(?:[^\s/>]*:)?br)(?=[\s/>])", re.I)


def _without(tags: re.Pattern, value: str) -> str:
    """value without these tags, a space where a paragraph, title or line breaks; references resolved, twice if nested."""
    bare = tags.sub(lambda m: " " if _BREAK.match(m[0]) else "", value)
    return html.unescape(html.unescape(bare))


_marked = re.compile("[<&]").search
_untagged = _series(lambda v: _without(_ANY_TAG, v) if _marked(v) else v)
_unmathed = _series(lambda v: _without(_MATH_TAG, html.unescape(v)) if _marked(v) else v)
_SPACE = r"[\s\x{1C}-\x{1F}]+"


#: White space that is not one plain space already.
_UNEVEN = r" [\s\x{1C}-\x{1F}]+|[\s\x{1C}-\x{1F}&&[^ ]][\s\x{1C}-\x{1F}]*"


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"(?U){_UNEVEN}", " "))


def clean_text(c: Column | str) -> Column:
    """Plain text of an abstract: no markup, label, publication notices or rights; null is an empty text."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    out = _untagged(F.regexp_replace(c, f"(?iU){fixed.ABSTRACT_TITLE}", ""))
    for pattern, new in ((fixed.ABSTRACT_LABEL, ""), (fixed.PUBLICATION_NOTICE, " "), (fixed.RIGHTS, "")):
        out = F.regexp_replace(out, f"(?iUd){pattern}", new)
    return _squeezed(out)


def plain_math_text(c: Column | str) -> Column:
    """Text about mathematics without known markup; null is an empty text."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return _squeezed(_unmathed(c))


# --- keys -----------------------------------------------------------------------------------------

#: In a normal form and case folded, which is plain lower case for ASCII.
_FOLDS = {form: _series(lambda v, form=form: v.lower() if v.isascii() else unicodedata.normalize(form, v).casefold()) for form in ("NFKC", "NFKD")}
_resolved = _series(html.unescape)
casefold = _series(str.casefold)


#: Of each key: the normal form, then what is replaced, in turn.
_KEYS = {
    "title": ("NFKC", [(f"(?U){_SPACE}", " "), ("^ | $", ""), (r"\.+$", "")]),
    "name": ("NFKD", [("&", "and"), (r"\p{M}+", ""), (f"(?U)^the{_SPACE}", ""), ("[^a-z0-9]+", "")]),
    "letters": ("NFKD", [(r"[^\p{L}\p{N}]+", "")]),
}


def _key(c: Column, name: str) -> Column:
    form, steps = _KEYS[name]
    out = _FOLDS[form](c)
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return out


def title_key(c: Column | str) -> Column:
    """A title for comparison; signs stay, as x+y and x-y are different titles."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return _key(_resolved(c), "title")


def name_key(c: Column | str) -> Column:
    """A journal's name in lower-case ASCII letters and digits, without a leading article."""
    return _key(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "name")


def normalized(c: Column | str) -> Column:
    """The letters and digits of a cleaned title."""
    c = F.col(c) if isinstance(c, str) else c
    return _key(clean_text(F.regexp_replace(c, fixed.TEX_FONTS, "")), "letters")


def client_network(value: str) -> str | None:
    """An IPv4 address, or the /64 network of an IPv6 address; a mapped IPv4 address is that; None if neither."""
    try:
        address = ipaddress.ip_address(value)
    except ValueError:
        return None
    address = getattr(address, "ipv4_mapped", None) or address
    return str(address) if address.version == 4 else str(ipaddress.ip_network((address, 64), strict=False))


client_key = _series(client_network)


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def title_ratio(a: Column | str, b: Column | str) -> Column:
    """Similarity of two titles by matching blocks, after both are reduced to letters and digits."""
    return _ratio(normalized(a), normalized(b))


def doi_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), fixed.DOI_ADDRESS, ""))


def arxiv_key(c: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), fixed.ARXIV_ADDRESS, "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.pdf$", ""), r"v\d+$", "")


def valid_issn(c: Column) -> Column:
    """Shape and check digit: weights 8 to 1, X for ten, sum divisible by eleven."""
    digits = F.regexp_replace(c, "-", "")
    total = sum((F.when(F.substring(digits, k, 1) == "X", F.lit(10)).otherwise(F.substring(digits, k, 1).try_cast("int")) * (9 - k) for k in range(1, 9)), F.lit(0))
    return F.coalesce(c.rlike(r"^\d{4}-\d{3}[\dX]$") & (total % 11 == 0), F.lit(False))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def collapse(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def unsuitable_title(c: Column) -> Column:
    """Whether a title names front matter, a correction or the like."""
    first_line = F.substring_index(c, "\n", 1)
    return c.rlike(f"(?iU){fixed.TITLE_OPENERS}") | first_line.rlike(f"(?iU){fixed.TITLE_ANYWHERE}") | c.rlike(f"(?iU)^.*{fixed.TITLE_NOTICES}")


def cut_abstract(c: Column) -> Column:
    """Cut at the first match of each pattern in turn. A plain search comes first, as most texts have none: a pattern
    that the whole text does not call for is not called for by a part of it."""
    pair = F.struct(c.alias("x"), F.lower(c).alias("low"))

    def cut(pattern: str, words: list[str]):
        met = lambda p: reduce(Column.__or__, [F.contains(p["low"], F.lit(w)) for w in words])
        return lambda p: F.struct(F.when(met(p), F.regexp_replace(p["x"], f"(?isU)(?:{pattern}).*$", "")).otherwise(p["x"]).alias("x"), p["low"].alias("low"))

    for pattern, words in zip(fixed.ABSTRACT_CUTS, fixed.ABSTRACT_CUT_WORDS, strict=True):
        pair = F.element_at(F.transform(F.array(pair), cut(pattern, words)), 1)  # p stands for the pair, so that it is named once
    return pair["x"]


def has_words(c: Column, n: int) -> Column:
    """Whether a text has n words or more; the text is not split further than that."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+", n + 2), lambda w: w != "")) >= n


def drop_dangling_codes(c: Column) -> Column:
    """c without subject codes at its end and space around it. A look at its ends tells most texts that need nothing."""
    codes = lambda x: F.when(F.right(x, F.lit(1)).rlike(r"(?U)[\d\s]"), F.regexp_replace(x, f"(?U){fixed.DANGLING_CODES}", "")).otherwise(x)
    space = lambda x: F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)
    return F.element_at(F.transform(F.transform(F.array(c), codes), space), 1)


def arxiv_id(c: Column) -> Column:
    """The identifier of a bare id or an https abstract link; null for anything else, and for text that is
    longer than 300 characters, not ASCII, or holds a backslash or control character."""
    plain = (F.length(c) <= 300) & c.rlike(r"^[\x20-\x5b\x5d-\x7e]*$")
    found = F.regexp_extract(F.trim(c), fixed.ARXIV_ID, 1)
    return F.when(plain & (found != ""), found)


def query_fields(title: Column, abstract: Column) -> tuple[Column, Column, Column]:
    """(title, abstract, error) of a search; the first rule that fails gives the error."""
    t, a = collapse(title), collapse(abstract)
    error = (
        F.when(title.isNull() | abstract.isNull(), "missing")
        .when(~F.length(t).between(3, 2000) | ~F.length(a).between(40, 30000), "length")
        .when(F.lower(t).isin(fixed.GENERIC_TITLES), "generic_title")
    )
    return t, a, error


def embedding_text(title: Column, abstract: Column, instruction: str | None = None) -> Column:
    """What is embedded of a record; searches carry an instruction."""
    body = F.concat_ws("\n", title, abstract)
    return body if instruction is None else F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), body)
