"""DuckDB SQL fragments mirroring the Column functions, for the oracle queries.

Each helper returns a SQL expression string; they compose into the oracle SQL
in ``semsift.plans.catalog``. Same constants as ``semsift.constants``.
"""
from __future__ import annotations

from semsift import constants as C

_UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LO = "abcdefghijklmnopqrstuvwxyz"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


STOP = str_list(C.STOP_WORDS)
ARTICLES = str_list(C.ENTITY_ARTICLES)


def clean(x: str) -> str:
    return f"translate(coalesce({x}, ''), {q(_UP + C.ASCII_PUNCT)}, {q(_LO)})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(C.ASCII_SPACE_CLASS)}), lambda w: w <> '')"


def plural(w: str) -> str:
    return (f"(CASE WHEN strlen({w}) > 3 AND suffix({w}, 's') "
            f"THEN left({w}, length({w}) - 1) ELSE {w} END)")


def kw_tokens(clean_x: str) -> str:
    return (f"list_filter(list_transform({words(clean_x)}, lambda w: {plural('w')}), "
            f"lambda w: NOT list_contains({STOP}, w))")


def token_set(clean_x: str) -> str:
    return f"list_distinct({kw_tokens(clean_x)})"


def entity(x: str) -> str:
    prefix = "^(" + "|".join(C.ENTITY_PREFIXES) + ")"
    stripped = f"regexp_replace({clean(x)}, {q(prefix)}, '')"
    kept = f"list_filter({words(stripped)}, lambda w: NOT list_contains({ARTICLES}, w))"
    return f"array_to_string(list_transform({kept}, lambda w: {plural('w')}), ' ')"


def first_words(x: str, n: int) -> str:
    return f"array_to_string(regexp_split_to_array({x}, '[ \n]+')[1:{n}], ' ')"


def quantize(v: str) -> str:
    return f"list_transform({v}, lambda x: round_even(x::DOUBLE, {C.VECTOR_DECIMALS})::FLOAT)"


def dot(a: str, b: str) -> str:
    return f"list_inner_product(({a})::DOUBLE[], ({b})::DOUBLE[])"


def norm(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def cos_dist(a: str, b: str) -> str:
    return (f"(1.0 - greatest(-1.0, least(1.0, {dot(a, b)} / ({norm(a)} * {norm(b)}))))")


def title_score(t: str, toks: str, cq: str) -> str:
    share = (f"(CASE WHEN len({toks}) > 0 THEN "
             f"len(list_filter({toks}, lambda x: contains({t}, x)))::DOUBLE / len({toks}) ELSE 0.0 END)")
    return (f"(CASE WHEN {t} = {cq} THEN {C.TITLE_EXACT} ELSE "
            f"(CASE WHEN contains({t}, {cq}) THEN {C.TITLE_CONTAINS} ELSE 0.0 END) + {share} END)")


def hash_dims(tokens: str, dim: int) -> str:
    """Signed feature-hash dimension per token (same rule as the default encoder)."""
    d = f"((('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}) + 1)"
    neg = "(substr(md5(t), 9, 1) IN ('8','9','a','b','c','d','e','f'))"
    return f"list_transform({tokens}, lambda t: CASE WHEN {neg} THEN -{d} ELSE {d} END)"


def model_tokens(x: str) -> str:
    """``[CLS]`` + all words + ``[SEP]``."""
    return f"list_concat(['[CLS]'], {words(f"coalesce({x}, '')")}, ['[SEP]'])"


def pool_dims(dims_col: str, dim: int) -> str:
    """Masked mean of signed one-hot token vectors (``dims_col`` from ``hash_dims``)."""
    return (f"list_transform(range(1, {dim + 1}), lambda i: "
            f"list_sum(list_transform({dims_col}, lambda s: CASE WHEN abs(s) = i THEN sign(s) ELSE 0 END))::DOUBLE"
            f" / len({dims_col}))")


def vec_norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE)))"


def unit(v: str, n: str) -> str:
    """Divide by a precomputed norm column ``n``; zero vector unchanged; to FLOAT."""
    return f"list_transform({v}, lambda y: CASE WHEN {n} > 0 THEN (y / {n})::FLOAT ELSE y::FLOAT END)"
