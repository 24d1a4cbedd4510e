"""Scalar text functions as Spark Column expressions (STR1-STR10, NUL1).

Everything except HTML entity decoding is a built-in expression, so it stays
inside whole-stage code generation. ``html.unescape`` has no built-in; it runs
in an Arrow-batched pandas UDF that only sees rows containing ``&`` (all other
rows are sent as null, which the UDF passes straight through).
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revscope.constants import TRUNCATE_LIMIT

# The whitespace set of Python's ``str.isspace`` written as an explicit class:
# Java's ``\s`` lacks \x1c-\x1f, \x85 and the Unicode spaces, RE2's lacks \x0b.
WS_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\p{Z}]"
TAG_PATTERN = r"<[^>]+>"
# Word characters of a Python ``\w`` match (letters, digits, underscore).
WORD_CHAR = r"[\p{L}\p{N}_]"
WORD_TOKEN_PATTERN = WORD_CHAR + "{2,}"
# A key-phrase token: word chars and inner hyphens, at least three chars, and
# word chars at both ends.
KEY_TOKEN_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_-]+[\p{L}\p{N}_]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def html_unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else None)


def html_unescape(c) -> Column:
    """Decode HTML entities; only rows with '&' cross into Python."""
    c = _col(c)
    return F.coalesce(html_unescape_udf(F.when(c.contains("&"), c)), c)


def collapse_ws(c) -> Column:
    return F.regexp_replace(_col(c), WS_CLASS + "+", " ")


def clean_text(c) -> Column:
    """STR1: unescape entities, tags → space, collapse whitespace, strip."""
    c = _col(c)
    unescaped = html_unescape(c)
    no_tags = F.regexp_replace(unescaped, TAG_PATTERN, " ")
    return F.trim(collapse_ws(no_tags))


def is_empty_text(c) -> Column:
    """FLT2: null counts as empty; only whitespace counts as empty."""
    return F.coalesce(_col(c), F.lit("")).rlike("^" + WS_CLASS + "*$")


def truncate(c, limit: int = TRUNCATE_LIMIT) -> Column:
    """STR2: unchanged when short enough, else cut, right-strip, '...'."""
    c = _col(c)
    head = F.regexp_replace(F.substring(c, 1, limit - 3), WS_CLASS + "+$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(head, F.lit("...")))


def word_tokens(c) -> Column:
    """STR4: lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD_TOKEN_PATTERN), F.lit(0))


def keyphrase_tokens(c) -> Column:
    """STR5: lower-cased tokens of word chars with inner hyphens, length ≥ 3."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(KEY_TOKEN_PATTERN), F.lit(0))


def ngrams(tokens, n: int) -> Column:
    """Space-joined n-grams of one order; rows shorter than n give [].

    Built by zipping shifted slices, so the lambdas only see their own
    arguments: the token array is computed once per row (a lambda that
    referred to it would re-evaluate the tokenizer for every position).
    """
    a = _col(tokens)
    if n == 1:
        return a
    m = F.greatest(F.size(a) - n + 1, F.lit(0))
    grams = F.slice(a, 1, m)
    for j in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(a, j, m), lambda x, y: F.concat(x, F.lit(" "), y))
    return grams


def word_ngrams(tokens, n_min: int = 1, n_max: int = 2) -> Column:
    """STR6: all n-grams of orders n_min..n_max, lower orders first."""
    parts = [ngrams(tokens, n) for n in range(n_min, n_max + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def whitespace_words(c) -> Column:
    """Python ``str.split()``: split on whitespace runs, drop empty pieces."""
    return F.filter(F.split(_col(c), WS_CLASS + "+"), lambda w: w != "")


def char_wb_ngrams(c, n_min: int = 3, n_max: int = 5) -> Column:
    """STR7: character n-grams inside word boundaries of the lower-cased text.

    Every whitespace-separated word is padded with one space on each side;
    for each order n up to the padded length all substrings of length n are
    produced; a padded word shorter than n_min is produced once as a whole.
    """
    words = whitespace_words(F.lower(_col(c)))

    def per_word(w):
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        length = F.length(padded)
        by_order = F.transform(
            F.sequence(F.lit(n_min), F.lit(n_max)),
            lambda n: F.when(
                n <= length,
                F.transform(F.sequence(F.lit(1), length - n + 1),
                            lambda i: F.substring(padded, i, n)),
            ).otherwise(F.array().cast("array<string>")),
        )
        short = F.when(length < n_min, F.array(padded)).otherwise(
            F.array().cast("array<string>"))
        return F.concat(F.flatten(by_order), short)

    return F.flatten(F.transform(words, per_word))


def padded_words(c) -> Column:
    """The lower-cased words of a text, each with a space of its own on either side (for STR7)."""
    words = F.trim(collapse_ws(F.lower(_col(c))))
    return F.when(words != "", F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" ")))


def remove_stop_words(tokens, stop_words) -> Column:
    """FLT7: drop stop words, keep order and repeats."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stop_words))]) if stop_words else None
    a = _col(tokens)
    if stop is None:
        return a
    return F.filter(a, lambda t: ~F.array_contains(stop, t))



def infer_focus(question, lexicon: list[tuple[str, str, int]]) -> Column:
    """STR3: first focus (by priority) whose marker occurs in the question."""
    q = F.lower(_col(question))
    by_focus: dict[str, list[str]] = {}
    order: dict[str, int] = {}
    for marker, focus, priority in lexicon:
        by_focus.setdefault(focus, []).append(marker)
        order[focus] = min(priority, order.get(focus, priority))
    expr = None
    for focus in sorted(by_focus, key=lambda f: order[f]):
        cond = None
        for m in by_focus[focus]:
            hit = q.contains(m)
            cond = hit if cond is None else (cond | hit)
        expr = F.when(cond, F.lit(focus)) if expr is None else expr.when(cond, F.lit(focus))
    return expr.otherwise(F.lit(None).cast("string")) if expr is not None else F.lit(None).cast("string")


def blank_to_null(c) -> Column:
    """NUL1: Python ``x or default`` also replaces the empty string."""
    return F.nullif(_col(c), F.lit(""))


def fixed4(c) -> F.Column:
    """'%.4f' of a non-negative value with at most 6 decimals, half-even,
    by integer arithmetic (the same digits in every engine)."""
    micro = F.round(_col(c) * 1000000).cast("long")
    q, r = F.floor(micro / 100).cast("long"), F.pmod(micro, F.lit(100))
    up = (r > 50) | ((r == 50) & (F.pmod(q, F.lit(2)) == 1))
    v = q + F.when(up, F.lit(1)).otherwise(F.lit(0))
    return F.concat(F.floor(v / 10000).cast("long").cast("string"), F.lit("."),
                    F.lpad(F.pmod(v, F.lit(10000)).cast("string"), 4, "0"))
