"""Column -> Column text analysis (clean, split, plural strip, stop words, entity).

Everything here is a Catalyst expression (built-in functions and array lambdas),
so it runs JVM-side, per row, with no shuffle and no Python.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semsift import constants as C
from semsift.functions.util import let

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_string(c) -> Column:
    """Delete the 32 ASCII punctuation characters and fold ASCII upper case.

    No space is inserted (``a-b`` -> ``ab``); non-ASCII characters are left as they
    are (``É`` stays ``É``), unlike ``lower()``.
    """
    return F.translate(F.coalesce(_col(c), F.lit("")), _UPPER + C.ASCII_PUNCT, _LOWER)


def split_words(c) -> Column:
    """Split on runs of ASCII whitespace; no empty tokens."""
    return F.filter(F.split(_col(c), C.ASCII_SPACE_CLASS), lambda w: w != "")


def strip_plural(w: Column) -> Column:
    """Drop a final ``s`` when the word is longer than three *bytes*."""
    return F.when(
        (F.octet_length(w) > 3) & w.endswith("s"), w.substr(F.lit(1), F.char_length(w) - 1)
    ).otherwise(w)


def _stop_array() -> Column:
    return F.array(*[F.lit(s) for s in C.STOP_WORDS])


# A word (run of non-ASCII-space characters) ending in "s" whose remaining part is
# longer than 2 bytes in UTF-8: >= 3 characters, or 2 characters of which one is
# non-ASCII, or 1 character of 3+ bytes (>= U+0800). Group 1 keeps the word minus "s".
_W = "[^ \\t\\n\\x0B\\f\\r]"
PLURAL_RE = ("(?<!" + _W + ")(" + _W + "{3,}|" + _W + "[^\\x00-\\x7F]|[^\\x00-\\x7F]" + _W
             + "|[^\\x00-\\x{7FF}])s(?!" + _W + ")")


def strip_plurals(clean_col) -> Column:
    """Plural strip of every word of a string in one regex pass (same rule as
    ``strip_plural`` applied word by word)."""
    return F.regexp_replace(_col(clean_col), PLURAL_RE, "$1")


def raw_words(c) -> Column:
    """Whitespace split without lambdas (``array_remove`` drops empty tokens)."""
    return F.array_remove(F.split(_col(c), C.ASCII_SPACE_CLASS), "")


def keyword_tokens(clean_col) -> Column:
    """Tokens of an already cleaned string, in order, duplicates kept.

    Split, plural strip, then stop-word removal (in that order, so ``whats``
    becomes ``what`` and is dropped).
    """
    stops = _stop_array()
    return F.filter(raw_words(strip_plurals(clean_col)), lambda w: ~F.array_contains(stops, w))


def token_set(clean_col) -> Column:
    """Distinct keyword tokens of an already cleaned string (native set ops)."""
    return F.array_except(raw_words(strip_plurals(clean_col)), _stop_array())


def token_hashes(tokens_col) -> Column:
    """64-bit token hashes (``xxhash64``) of an array of tokens."""
    return F.transform(_col(tokens_col), lambda t: F.xxhash64(t))


def token_counts(tokens_col) -> Column:
    """``array<struct<token,freq>>`` of an array of tokens, sorted by token.

    Run-length count over the sorted array: no explode, no shuffle, O(n log n)
    per row. Intermediate arrays are bound once with ``let``.
    """
    empty = F.array().cast("array<struct<token:string,freq:int>>")

    def runs(s):
        n = F.size(s)

        def from_starts(starts):
            return F.transform(
                starts,
                lambda p, j: F.struct(
                    F.get(s, p).alias("token"),
                    (F.coalesce(F.get(starts, j + 1), n) - p).cast("int").alias("freq"),
                ),
            )

        starts = F.filter(F.sequence(F.lit(0), n - 1),
                          lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.when(n > 0, let(starts, from_starts)).otherwise(empty)

    return let(F.sort_array(_col(tokens_col)), runs)      # compiled; array_sort() interprets its comparison


def keyword_counts(clean_col) -> Column:
    """``array<struct<token,freq>>`` of the keyword tokens of a cleaned string.

    Counted before stop-word removal (the run array is much shorter than the token
    array, so the stop-word test runs once per distinct token)."""
    stops = _stop_array()
    runs = token_counts(raw_words(strip_plurals(clean_col)))
    return F.filter(runs, lambda r: ~F.array_contains(stops, r["token"]))


def token_stats(text_col) -> Column:
    """Per-document ``array<struct<hash:bigint,freq:smallint>>`` sorted by hash.

    The text is cleaned here (as at ingest); frequencies are clamped to SMALLINT.
    """
    counts = keyword_counts(clean_string(text_col))
    return F.sort_array(
        F.transform(
            counts,
            lambda c: F.struct(
                F.xxhash64(c["token"]).alias("hash"),
                F.least(c["freq"], F.lit(C.FREQ_CAP)).cast("smallint").alias("freq"),
            ),
        )
    )


def _prefix_regex() -> str:
    return "^(" + "|".join(C.ENTITY_PREFIXES) + ")"


def extract_entity(query_col) -> Column:
    """Main entity of a question, the string that gets embedded for a query.

    Clean, strip the first matching question prefix at offset 0 (no word
    boundary: ``defined x`` -> ``d x``), split, drop articles, plural strip,
    join by one space. The stop-word list is *not* applied.
    """
    q = F.regexp_replace(clean_string(query_col), _prefix_regex(), "")
    arts = F.array(*[F.lit(a) for a in C.ENTITY_ARTICLES])
    words = F.filter(split_words(q), lambda w: ~F.array_contains(arts, w))
    return F.array_join(F.transform(words, strip_plural), " ")


def first_words(text_col, n: int) -> Column:
    """First ``n`` words of a text split on spaces/newlines, joined by one space."""
    return F.array_join(F.slice(F.split(_col(text_col), "[ \n]+"), 1, n), " ")
