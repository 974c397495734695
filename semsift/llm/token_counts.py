"""Token counts by the whole-token shortcut (operator 12).

A byte-level BPE tokenizer first splits a text into pre-tokens and then merges the bytes
of each by itself. Before the job starts, every vocabulary string is put through the
merges alone: those that come out as one token are proven whole, so a pre-token equal to
one of them counts 1 without any merging. Only other pre-tokens are merged; a task keeps
the counts of those it has met, up to a fixed number of them.

The text is split by the tokenizer's own pattern with the ``regex`` module. Where that
module's Unicode tables and the tokenizer's differ (``UNSURE``: scripts with recent
additions), the whole text goes through the tokenizer itself, so counts equal the
library's on every text. Strings of special tokens inside texts count as one token, which
is the library's default. Long texts are cut, in front of a single space between two
other characters, into blocks of bounded size; no pre-token crosses such a place.

Nothing is shuffled: one pass over the texts, one Arrow batch at a time. A null or empty
text has no bytes and no tokens; null ids and repeated rows are kept as they are; an empty
table gives no rows. The broadcast holds the tokenizer file and at most one string per
vocabulary entry.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from semsift.llm.common import give_back, pick
from semsift.llm.tokenize import PATTERN, _merge_ranks

#: Characters whose class may differ between the two Unicode tables; everything outside
#: is tested to be split alike.
UNSURE = ("[԰-֏ࡠ-ࣿఀ-೿₀-₟Ꟁ-ꟿꬰ-꭯"
          "\U00010000-\U0001efff\U0001fb00-\U0010ffff]")
#: Merged pre-tokens a task remembers; beyond it the task starts over (counts stay the same).
MAX_KNOWN = 300_000
#: Longest pre-token that is remembered.
MAX_KNOWN_CHARS = 64
#: Characters of a text that are split at a time.
BLOCK_CHARS = 1 << 20
#: Added to a whole token's count, so that one sum tells direct counts from merged ones.
DIRECT = 1 << 40


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


def merge_model(source: str):
    """``merges(text) -> number of tokens`` of one pre-token, by the tokenizer's own model."""
    from tokenizers import Tokenizer
    model, alphabet = Tokenizer.from_str(source).model, byte_alphabet()
    return lambda text: len(model.tokenize(text.encode().decode("latin-1").translate(alphabet)))


def fast_merges(source: str, whole: list[str]):
    """As ``merge_model``, several times faster on rare words: the same merges by
    ``tiktoken``. That library takes any vocabulary string whole, so entries that are not
    proven whole stay with the tokenizer's model."""
    import tiktoken
    ranks, proven = _merge_ranks(json.loads(source)), set(whole)
    unproven = {b for b in ranks if b.decode(errors="replace") not in proven}
    encode = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    exact = merge_model(source)
    return lambda text: exact(text) if text.encode() in unproven else len(encode(text))


def prove_whole_tokens(source: str) -> list[str]:
    """Vocabulary strings that the merges turn into one token when they stand alone.

    Bytes that are no text by themselves are left out: no pre-token equals them."""
    merges = merge_model(source)
    back = {c: b for b, c in byte_alphabet().items()}
    spec = json.loads(source)
    special = {t["content"] for t in spec["added_tokens"]}
    whole = []
    for entry in spec["model"]["vocab"]:
        if entry in special or any(c not in back for c in entry):
            continue
        try:
            text = bytes(back[c] for c in entry).decode()
        except UnicodeDecodeError:
            continue
        if merges(text) == 1:
            whole.append(text)
    return whole


class _Counts(dict):
    """Tokens by pre-token: whole tokens from the start, others merged when first met."""

    def __init__(self, whole: list[str], merges):
        super().__init__(dict.fromkeys(whole, 1 + DIRECT))
        self.whole, self.merges = whole, merges

    def __missing__(self, piece: str) -> int:
        n = self.merges(piece)
        if len(piece) <= MAX_KNOWN_CHARS:
            if len(self) >= len(self.whole) + MAX_KNOWN:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1 + DIRECT))
            self[piece] = n
        return n


_CUT = regex.compile(r"(?<=\S) (?=\S)")


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in blocks of about ``size`` characters that split alone as they split together."""
    at = 0
    while len(text) - at > size:
        cut = _CUT.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


class TokenCounter:
    """``counter(text)`` gives the text's tokens and how many of them were counted directly."""

    def __init__(self, source: str, whole: list[str], block_chars: int = BLOCK_CHARS):
        from tokenizers import Tokenizer
        spec = json.loads(source)
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] \
                or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("only plain byte-level tokenizers split as this operator assumes")
        self.tokenizer = Tokenizer.from_str(source)
        self.counts = _Counts(whole, fast_merges(source, whole))
        self.split = regex.compile(PATTERN)
        self.unsure = regex.compile(UNSURE)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.block_chars = block_chars

    def __call__(self, text: str) -> tuple[int, int]:
        if not text.isascii() and self.unsure.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids), 0
        parts = self.specials.split(text) if self.specials and self.specials.search(text) else [text]
        total = len(parts) - 1
        for part in parts:
            for block in blocks(part, self.block_chars):
                total += sum(map(self.counts.__getitem__, self.split.findall(block)))
        return total % DIRECT, total // DIRECT


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more
    than ``limit`` tokens) and ``n_direct``, the tokens that needed no merging."""
    with open(tokenizer_path, encoding="utf-8") as file:
        source = file.read()
    sent = docs.sparkSession.sparkContext.broadcast((source, prove_whole_tokens(source)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(*sent.value)
        for batch in batches:
            tokens, direct, size = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n, of_them = counter(text)
                tokens.append(n)
                direct.append(of_them)
                size.append(len(text) if text.isascii() else len(text.encode()))
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in (size, tokens, direct))],
                                  names=["id", "n_bytes", "n_tokens", "n_direct"])
        del counter
        give_back()

    rows = pick(docs, id=id_col, text=text_col)
    kind = rows.schema["id"].dataType
    fields = StructType([StructField("id", kind)])
    for name in ("n_bytes", "n_tokens", "n_direct"):
        fields = fields.add(name, "long")
    out = rows.mapInArrow(run, fields)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"), "n_direct")
