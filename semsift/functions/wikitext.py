"""Column -> Column wiki-markup cleaning and article normalisation.

Steps C2..C12 are one ``regexp_replace`` each (Java regex, JVM-side, codegen); the HTML
entity decode (C1) is an expression too.
"""
from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from semsift import constants as C
from semsift.functions.util import let

# --- fixed values: markup patterns, applied in this order -------------------
# (Java syntax: (?d) makes '.' stop only at '\n'; (?U) makes '\s' Unicode-aware;
#  U+001C..U+001F are listed because Python counts them as whitespace.)
_WS = "[\\s\\x1c-\\x1f]"
MARKUP_STEPS = (
    ("(?s)<!--.*?-->", ""),                                           # comments
    ("(?s)<ref[^>/]*?>.*?</ref>", ""),                                # <ref>..</ref>
    ("<ref[^/>]*/>", ""),                                             # <ref/>
    ("(?s)\\{\\{.*?\\}\\}", ""),                                      # {{templates}}
    ("(?id)\\[\\[(File|Image|Category):.*?\\]\\]", ""),               # files, categories
    ("\\[\\[[^|\\]]+\\|([^\\]]+)\\]\\]", "$1"),                       # [[target|label]]
    ("\\[\\[([^\\]]+)\\]\\]", "$1"),                                  # [[text]]
    ("(?U)\\[https?://[^\\s\\x1c-\\x1f\\]]+" + _WS + "?([^\\]]*)\\]", "$1"),  # [http://x label]
    ("[\\[\\]]", ""),                                                 # stray brackets
    ("(?d)==+.*?==+", ""),                                            # == headings ==
)
_WS_RUN = "(?U)" + _WS + "+"
_HAS_NON_SPACE = "(?U)[^\\s\\x1c-\\x1f]"
_EDGE_SPACE = "(?U)^" + _WS + "+|" + _WS + "+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# HTML character references: the standard's names come with Python; most carry a
# semicolon, a few older ones are also read without it.
ENTITIES = dict(sorted(html5.items(), key=lambda e: e[0] not in ("amp;", "lt;", "gt;", "quot;", "nbsp;")))
OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
REFERENCE = "^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
#: Numbers 128 to 159 are read as Windows-1252 where that has a character.
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
REPLACEMENT = "\ufffd"


def _literal_map(values: dict) -> Column:
    """A constant map; parsed from one literal, which Spark folds away."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _numbered(ref: Column) -> Column:
    """The character of a numeric reference; too large ones count as 0x110000."""
    hexa = F.regexp_extract(ref, "^#[xX]0*([0-9a-fA-F]+)", 1)
    deci = F.regexp_extract(ref, "^#0*([0-9]+)", 1)
    number = (F.when(hexa != "", F.when(F.length(hexa) <= 6, F.conv(hexa, 16, 10).cast("int")))
              .when(F.length(deci) <= 7, deci.cast("int")))

    def char(n: Column) -> Column:
        written = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        silent = n.between(1, 8) | n.between(11, 11) | n.between(14, 31) | n.between(127, 159) \
            | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return (F.when(n.isin(*WINDOWS), F.try_element_at(_literal_map(WINDOWS), n.cast("string")))
                .when(n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit(REPLACEMENT))
                .when(silent, F.lit("")).otherwise(written))

    return let(number, char)


def _decoded(part: Column) -> Column:
    """What follows an ``&``, with the reference it begins with decoded, or as it was."""
    def with_ref(ref: Column) -> Column:
        rest = F.substring(part, F.length(ref) + 1, F.length(part))
        return (F.when(ref == "", F.concat(F.lit("&"), part))
                .when(ref.startswith("#"), F.concat(_numbered(ref), rest))
                .otherwise(let(F.try_element_at(_literal_map(ENTITIES), ref), lambda named: F.when(
                    named.isNotNull(), F.concat(named, rest)).otherwise(let(
                        F.regexp_extract(part, "^(" + "|".join(OPEN_NAMES) + ")", 1), lambda short: F.when(
                            short == "", F.concat(F.lit("&"), part)).otherwise(F.concat(
                                F.try_element_at(_literal_map({n: html5[n] for n in OPEN_NAMES}), short),
                                F.substring(part, F.length(short) + 1, F.length(part)))))))))

    return let(F.regexp_extract(part, REFERENCE, 1), with_ref)


def html_unescape(c) -> Column:
    """Decode HTML entities (named HTML5 entities and numeric references) in one pass."""
    col = _col(c)

    def joined(parts: Column) -> Column:
        after = F.transform(F.slice(parts, 2, F.size(parts)), _decoded)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(after, ""))

    return F.when(col.contains("&"), let(F.split(col, "&"), joined)).otherwise(col)


def strip_markup(c) -> Column:
    """Markup removal C2..C12 without the entity decode (pure JVM)."""
    col = F.coalesce(_col(c), F.lit(""))
    for pattern, repl in MARKUP_STEPS:
        col = F.regexp_replace(col, pattern, repl)
    return py_strip(F.regexp_replace(col, _WS_RUN, " "))


def clean_wikitext(c, decode_entities: bool = True) -> Column:
    """Full markup cleaning: entity decode, then C2..C12; NULL -> ''."""
    col = F.coalesce(_col(c), F.lit(""))
    if decode_entities:
        col = html_unescape(col)
    return strip_markup(col)


def py_strip(c) -> Column:
    """Strip leading/trailing Unicode whitespace (Python ``str.strip`` semantics)."""
    return F.regexp_replace(_col(c), _EDGE_SPACE, "")


def has_text(c) -> Column:
    """True when the text is non-null and has a non-whitespace character."""
    col = _col(c)
    return col.isNotNull() & col.rlike(_HAS_NON_SPACE)


def is_prepare_redirect(c) -> Column:
    """Stripped text starts with ``#redirect``, any case (prepare-time filter)."""
    return F.lower(py_strip(c)).startswith(C.REDIRECT_PREFIX)


def normalize_article(c, decode_entities: bool = True) -> Column:
    """Prepare-time body: strip, clean markup, lower-case, curly apostrophe -> ``'``."""
    cleaned = clean_wikitext(py_strip(c), decode_entities)
    return F.replace(F.lower(cleaned), F.lit("’"), F.lit("'"))
