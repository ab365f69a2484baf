"""Text column functions: Python-compatible strip, HTML-ish cleaning, validity checks, prefixes.

All of these are JVM expressions except HTML entity decoding, which has no built-in: only rows that
contain ``&`` are shipped (Arrow batches) to Python's ``html.unescape``; the others pass NULL.
Java regexes run with ``(?U)`` so ``\\s``, ``\\d`` and ``\\b`` are Unicode-aware like Python's ``re``.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values that must equal the reference's cleaning rules (order matters) ----
IMG_TAG = r"(?isU)<img[^>]*>"
A_TAG = r"(?isU)<a\s+[^>]*>(.*?)</a>"
ANY_TAG = r"(?isU)<[^>]+>"
URL_HTTP = r"(?iU)https?://\S+"
URL_WWW = r"(?iU)\bwww\.\S+"
URL_UNDERSCORE = r"(?iU)http___\S+"
ISO_DATETIME = r"(?U)\b\d{4}[-/]\d{2}[-/]\d{2}[ T]\d{2}:\d{2}(?::\d{2})?\b"
RFC_DATE = (
    r"(?iU)\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+\d{1,2}\s+"
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\s+\d{2}:\d{2}(?::\d{2})?(?:\s+[A-Z]{2,4})?\b"
)
TIME_12H = r"(?iU)\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)\b"
# valid_text defaults
MIN_ALPHA = 10
MIN_LENGTH = 20
# ---- end of fixed values ----


# Python's whitespace (str.isspace / re's \s for str patterns), derived from the rule itself
PY_WS = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
# Java's (?U)\s is Unicode White_Space; Python's set adds the separators U+001C..U+001F
_WS_RUN = r"(?U)[\s\x{1c}-\x{1f}]+"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: removes Python whitespace at both ends (a character-set trim, no regex)."""
    return F.btrim(c, F.lit(PY_WS))


def collapse_ws(c: Column) -> Column:
    """``re.sub(r'\\s+', ' ', s).strip()`` with Python's whitespace set."""
    return py_strip(F.regexp_replace(c, _WS_RUN, " "))


# the characters after "&" that html.unescape can act on; other rows are never shipped to Python
ENTITY_START = r"&(#|[^\t\n\f <&#;])"


@F.pandas_udf(StringType())
def _unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def bind(c: Column, f) -> Column:
    """Evaluate ``c`` once and apply ``f`` to it (a lambda variable), instead of letting the optimizer
    inline ``c`` at every use inside ``f``."""
    return F.element_at(F.transform(F.array(c), f), 1)


def html_unescape(c: Column) -> Column:
    """``html.unescape`` for rows that hold an entity start; other rows stay in the JVM (NULL is shipped)."""
    return F.coalesce(_unescape_udf(F.when(c.rlike(ENTITY_START), c)), c)


def _guarded(s: Column, needle: Column, pattern: str, repl: str = "") -> Column:
    """``regexp_replace`` only where a match is possible (a cheap substring test first)."""
    return F.when(needle, F.regexp_replace(s, pattern, repl)).otherwise(s)


def _clean_chain(s: Column) -> Column:
    """Each rule runs only where a match is possible; the tests are plain substring checks that every
    match of the rule must contain (``<`` for tags, ``://``, ``w.``/``W.``, ``___`` for URLs, ``:`` for times)."""
    def has(x, *subs):
        out = F.lit(False)
        for sub in subs:
            out = out | x.contains(sub)
        return out

    s = bind(s, lambda x: _guarded(x, has(x, "<"), IMG_TAG))
    s = bind(s, lambda x: _guarded(x, has(x, "<"), A_TAG, "$1"))
    s = bind(s, lambda x: _guarded(x, has(x, "<"), ANY_TAG))
    s = bind(s, lambda x: _guarded(x, has(x, "://"), URL_HTTP))
    s = bind(s, lambda x: _guarded(x, has(x, "w.", "W."), URL_WWW))
    s = bind(s, lambda x: _guarded(x, has(x, "___"), URL_UNDERSCORE))
    s = bind(s, lambda x: _guarded(x, has(x, ":"), ISO_DATETIME))
    s = bind(s, lambda x: _guarded(x, has(x, ":"), RFC_DATE))
    s = bind(s, lambda x: _guarded(x, has(x, ":"), TIME_12H))
    return collapse_ws(s)


def clean_text(c: Column, unescape: bool = True) -> Column:
    """Entities → drop <img> → keep <a> inner text → drop tags → drop URLs → drop dates/times → collapse spaces.

    NULL/empty input gives ``''``.
    """
    s = F.coalesce(c, F.lit(""))
    if unescape:
        s = html_unescape(s)
    return _clean_chain(s)


def _valid_of(t: Column, min_alpha: int, min_length: int) -> Column:
    n = F.length(t)
    # "at least k letters" stops at the k-th letter instead of counting every letter of a long text
    enough_letters = t.rlike(f"^(?:[^\\p{{L}}]*\\p{{L}}){{{min_alpha}}}") if min_alpha > 0 else F.lit(True)
    is_none = (n == 4) & (F.lower(t) == "none")
    return (n > 0) & ~is_none & ~t.rlike(r"^[\\/_-]+$") & enough_letters & (n >= min_length)


def is_valid_text(c: Column, min_alpha: int = MIN_ALPHA, min_length: int = MIN_LENGTH) -> Column:
    """Non-empty, not ``none``, not only ``\\ / - _``, at least ``min_alpha`` letters and ``min_length`` chars
    (letters = Unicode category L, as Python's ``isalpha``; case does not change any of these tests)."""
    return bind(py_strip(F.coalesce(c, F.lit(""))), lambda t: _valid_of(t, min_alpha, min_length))


def clean_and_check(c: Column, min_alpha: int = MIN_ALPHA, min_length: int = MIN_LENGTH, unescape: bool = True) -> Column:
    """struct(text = clean_text(c), ok = is_valid_text(text)) with the cleaning evaluated once."""
    return bind(
        clean_text(c, unescape),
        lambda x: F.struct(x.alias("text"), is_valid_text(x, min_alpha, min_length).alias("ok")),
    )


def first_line(c: Column) -> Column:
    return F.element_at(F.split(c, "\n", 2), 1)


def rest_lines(c: Column) -> Column:
    """Everything after the first newline (NULL when there is none)."""
    parts = F.split(c, "\n", 2)
    return F.when(F.size(parts) > 1, F.element_at(parts, 2))
