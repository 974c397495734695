"""Vocabulary (S10) and model-input encoding.

``encode_tokens`` looks up the first ``max_len - 2`` words of every row in the
vocabulary. A vocabulary within a checked bound goes to every task and words are looked
up where they are, an Arrow batch at a time, with no shuffle; a larger one is joined.
Rows are told apart by position, not by key, so a repeated key stays two rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semsift import constants as C
from semsift.functions.text import split_words
from semsift.session import materialize
from semsift.sources.lines import numbered_lines

#: A vocabulary up to this many characters and words is sent to every task.
MAX_BROADCAST_VOCAB_CHARS, MAX_BROADCAST_VOCAB_ROWS = 64 << 20, 2_000_000


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """One token per line -> ``(token, token_id)``, id = zero-based line number; a token
    repeated on a later line keeps the later id."""
    lines = numbered_lines(spark.read.text(path))
    return lines.groupBy(F.col("value").alias("token")).agg(F.max("ordinal").alias("token_id"))


def vocab_from_words(df: DataFrame, text_col: str) -> DataFrame:
    """Vocabulary of the distinct whitespace words of a text column.

    Ids: ``[PAD]`` 0, ``[UNK]`` 1, ``[CLS]`` 2, ``[SEP]`` 3, then the words in
    ascending order from 4: positions in a distributed sort plus the partitions' offsets.
    """
    spark = df.sparkSession
    words = (df.select(F.explode(split_words(F.col(text_col))).alias("token")).distinct()
             .filter(~F.col("token").isin(C.PAD, C.UNK, C.CLS, C.SEP)))
    # a total sort numbers its rows upwards: partition in the high bits, position below
    rows = materialize(words.orderBy("token").withColumn("m", F.monotonically_increasing_id()), "vocab")
    part = F.shiftright("m", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    body = rows.withColumn("part", part).join(offsets, "part").select(
        "token", (F.col("off") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + 4).alias("token_id"))
    specials = spark.createDataFrame([(C.PAD, 0), (C.UNK, 1), (C.CLS, 2), (C.SEP, 3)],
                                     "token string, token_id long")
    return specials.unionByName(body)


def special_ids(vocab: DataFrame) -> dict[str, int]:
    """Ids of the four special tokens; a missing one gets id 0."""
    rows = vocab.filter(F.col("token").isin(C.PAD, C.UNK, C.CLS, C.SEP)).collect()
    found = {r["token"]: int(r["token_id"]) for r in rows}
    return {t: found.get(t, 0) for t in (C.PAD, C.UNK, C.CLS, C.SEP)}


def _first_words(text_col: str, n: int):
    """The first ``n`` words; the text behind them is not split."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"^{C.ASCII_SPACE_CLASS}", "")
    return F.filter(F.slice(F.split(text, C.ASCII_SPACE_CLASS, n + 1), 1, n), lambda w: w != "") \
        if n else F.array().cast("array<string>")


def _looked_up(df: DataFrame, words, vocab: DataFrame, unk: int):
    """``df`` with ``_ids`` by a lookup within tasks, or None if the vocabulary is too large."""
    table = vocab.select("token", "token_id").limit(MAX_BROADCAST_VOCAB_ROWS + 1)
    rows, chars = table.agg(F.count(F.lit(1)), F.sum(F.length("token"))).first()
    if rows > MAX_BROADCAST_VOCAB_ROWS or (chars or 0) > MAX_BROADCAST_VOCAB_CHARS:
        return None
    known = table.toArrow()
    sent = df.sparkSession.sparkContext.broadcast(
        (known.column("token").combine_chunks(), known.column("token_id").to_numpy().astype(np.int64)))

    @F.arrow_udf("array<bigint>")
    def ids(batch: pa.Array) -> pa.Array:
        tokens, numbers = sent.value
        if isinstance(batch, pa.ChunkedArray):
            batch = batch.combine_chunks()
        at = pc.fill_null(pc.index_in(batch.flatten().cast(tokens.type), value_set=tokens), -1) \
            .to_numpy(zero_copy_only=False)
        found = np.where(at >= 0, numbers[at], unk) if len(numbers) else np.full(len(at), unk)
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()),
                                        pa.array(found, pa.int64()))

    return df.withColumn("_ids", ids(words))


def _joined(df: DataFrame, words, vocab: DataFrame, unk: int) -> DataFrame:
    """``df`` with ``_ids`` by an equi-join on the word, for a vocabulary of any size."""
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_words", words), "encode")
    found = (rows.select("_row", F.posexplode("_words").alias("pos", "token"))
             .join(vocab.select("token", "token_id"), "token", "left")
             .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
                 "pos", F.coalesce("token_id", F.lit(unk)).alias("id")))).alias("_found")))
    return (rows.join(found, "_row", "left")
            .withColumn("_ids", F.coalesce(F.transform("_found", lambda s: s["id"]), F.array().cast("array<bigint>")))
            .drop("_row", "_words", "_found"))


def encode_tokens(df: DataFrame, text_col: str, vocab: DataFrame, max_len: int = C.MAX_SEQ_LEN,
                  key: str = "doc_id") -> DataFrame:
    """``(key, input_ids, attention_mask, token_type_ids)``, each of length ``max_len``.

    ``[CLS]`` + ids of the first ``max_len - 2`` words (``[UNK]`` when absent) +
    ``[SEP]``, padded with ``[PAD]``. The mask is ``id != pad`` (a literal
    ``[PAD]`` word is masked too); token types are all 0.
    """
    sp = special_ids(vocab)
    pad, unk, cls, sep = sp[C.PAD], sp[C.UNK], sp[C.CLS], sp[C.SEP]
    rows = df.select(F.col(key), F.col(text_col).alias("_text"))
    words = _first_words("_text", max(max_len - 2, 0))
    looked = _looked_up(rows, words, vocab, unk)
    if looked is None:
        looked = _joined(rows, words, vocab, unk)
    ids = F.concat(F.array(F.lit(cls).cast("long")), F.col("_ids"), F.array(F.lit(sep).cast("long")))
    padded = F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.lit(max_len) - F.size(ids)))
    return (looked.select(key, padded.alias("input_ids"))
            .withColumn("attention_mask",
                        F.transform("input_ids", lambda x: F.when(x != pad, 1).otherwise(0).cast("long")))
            .withColumn("token_type_ids", F.array_repeat(F.lit(0).cast("long"), max_len)))
