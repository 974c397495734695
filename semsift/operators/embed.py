"""Text embedding (E4-E9, A5): pluggable encoders behind one Column interface.

An encoder maps a text Column to an ``array<float>`` Column of unit length.
The JVM does the tokenising; Python only runs the "model" on Arrow batches:

* ``HashingEncoder`` (default): signed feature hashing of ``[CLS]`` + all whitespace
  words + ``[SEP]``; token vector = signed one-hot at
  ``md5(token)[0:8] mod dim``; masked mean pooling and L2 normalisation. It is a
  deterministic bag-of-words stand-in, *not* a neural model. Token dimensions are
  computed JVM-side; the pooling is a scalar pandas UDF over an int array.
* ``OnnxEncoder``: a sentence-transformer style ONNX model (inputs
  ``input_ids``, ``attention_mask``, ``token_type_ids``; output token
  vectors), loaded once per Python worker, run single-threaded per task with
  masked mean pooling + L2 normalisation in numpy. ``onnxruntime`` is imported
  lazily; no model file ships with this repository.
"""
from __future__ import annotations

import re
from hashlib import md5
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semsift import constants as C
from semsift.functions.text import split_words
from semsift.functions.vectors import quantize

_FLOAT_ARRAY = T.ArrayType(T.FloatType())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def model_tokens(text_col) -> Column:
    """``[CLS]`` + all whitespace words + ``[SEP]``."""
    words = split_words(F.coalesce(_col(text_col), F.lit("")))
    return F.concat(F.array(F.lit(C.CLS)), words, F.array(F.lit(C.SEP)))


def signed_hash_dims(tokens_col, dim: int) -> Column:
    """Per token ``+-(d + 1)``: ``d = int(md5(t)[0:8], 16) mod dim``, sign from ``md5(t)[8]``."""
    def one(t):
        h = F.md5(t)
        d = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)) + 1
        neg = F.substring(h, 9, 1).isin("8", "9", "a", "b", "c", "d", "e", "f")
        return F.when(neg, -d).otherwise(d).cast("int")
    return F.transform(_col(tokens_col), one)


def _word_dims(words: pa.Array, dim: int) -> pa.Array:
    """``signed_hash_dims`` of arrays of words: each distinct word of a batch is hashed once."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    coded = words.flatten().dictionary_encode()
    signed = np.zeros(len(coded.dictionary), np.int32)
    for n, word in enumerate(coded.dictionary.to_pylist()):
        h = md5(word.encode()).digest()
        d = int.from_bytes(h[:4], "big") % dim + 1
        signed[n] = -d if h[4] >= 128 else d
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()),
                                    pa.array(signed[coded.indices.to_numpy(zero_copy_only=False)]))


def _pool_signed_arrow(dims: pa.Array, dim: int) -> pa.Array:
    """Signed one-hot token vectors -> masked mean -> unit length, on Arrow buffers."""
    if isinstance(dims, pa.ChunkedArray):
        dims = dims.combine_chunks()
    n = len(dims)
    lens = pc.fill_null(pc.list_value_length(dims), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = dims.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    cell = np.repeat(np.arange(n, dtype=np.int64) * dim, lens) + (np.abs(flat) - 1)
    out = np.bincount(cell, weights=np.sign(flat).astype(np.float64),
                      minlength=n * dim).reshape(n, dim)
    out = out / np.maximum(lens, 1)[:, None]                     # masked mean (A5)
    unit = _unit_rows(out)
    offsets = pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(unit.ravel(), pa.float32()))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    nrm = np.linalg.norm(m, axis=1)
    safe = np.where(nrm > 0, nrm, 1.0)
    return (m / safe[:, None]).astype(np.float32)                # zero vector stays zero (E6)


def _normalize_rows(m: np.ndarray) -> pd.Series:
    return pd.Series(list(_unit_rows(m)))


class HashingEncoder:
    """Default deterministic encoder (feature hashing); see module docstring."""

    never_empty = True       # always a dim-length vector (P6 cannot fire)

    def __init__(self, dim: int = 384):
        self.dim = d = int(dim)

        @F.arrow_udf(_FLOAT_ARRAY)
        def _pool(dims: pa.Array) -> pa.Array:
            return _pool_signed_arrow(dims, d)

        @F.arrow_udf(_FLOAT_ARRAY)
        def _pool_words(words: pa.Array) -> pa.Array:
            return _pool_signed_arrow(_word_dims(words, d), d)

        self._pool, self._pool_words = _pool, _pool_words

    def token_dims(self, text_col) -> Column:
        return signed_hash_dims(model_tokens(text_col), self.dim)

    def embed(self, text_col) -> Column:
        return self._pool_words(model_tokens(text_col))

    def vector_of(self, dims: list[int]) -> list[float]:
        """The stored (quantised) vector of one text's ``token_dims``."""
        unit = _pool_signed_arrow(pa.array([dims], pa.list_(pa.int32())), self.dim)
        return np.round(np.asarray(unit[0].as_py(), np.float64), C.VECTOR_DECIMALS).astype(np.float32).tolist()


_ONNX_CACHE: dict = {}


def _onnx_session(model_path: str):
    sess = _ONNX_CACHE.get(model_path)
    if sess is None:
        import onnxruntime as ort  # gated: only needed when a model is used
        opts = ort.SessionOptions()
        opts.intra_op_num_threads = 1          # Spark supplies the parallelism
        opts.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_EXTENDED
        sess = ort.InferenceSession(model_path, opts, providers=["CPUExecutionProvider"])
        _ONNX_CACHE[model_path] = sess
    return sess


def pool_token_vectors(tok: np.ndarray, ids: np.ndarray, pad_id: int) -> pd.Series:
    """Masked mean over positions whose id is not ``pad_id``, then L2 normalise."""
    mask = (ids != pad_id).astype(np.float64)[:, :, None]
    summed = (tok.astype(np.float64) * mask).sum(axis=1)
    cnt = np.maximum(mask.sum(axis=1), 1.0)
    return _normalize_rows(summed / cnt)


_VOCAB_CACHE: dict = {}
_ASCII_WS = re.compile(C.ASCII_SPACE_CLASS)


def _load_vocab(path: str) -> dict:
    """token -> zero-based line number (a later duplicate wins), cached per worker."""
    v = _VOCAB_CACHE.get(path)
    if v is None:
        v = {}
        with open(path, encoding="utf-8") as f:
            for i, line in enumerate(f):
                v[line.rstrip("\n")] = i
        _VOCAB_CACHE[path] = v
    return v


def encode_batch(texts, vocab: dict, max_len: int) -> np.ndarray:
    """E1/E2 for one Arrow batch: ``[CLS]`` + whole-word ids (``[UNK]`` if absent) of the
    first ``max_len - 2`` whitespace words + ``[SEP]``, padded with ``[PAD]``."""
    pad, unk, cls, sep = (vocab.get(t, 0) for t in (C.PAD, C.UNK, C.CLS, C.SEP))
    out = np.full((len(texts), max_len), pad, np.int64)
    for r, t in enumerate(texts):
        words = [w for w in _ASCII_WS.split(t or "") if w][: max_len - 2]
        ids = [cls] + [vocab.get(w, unk) for w in words] + [sep]
        out[r, : len(ids)] = ids
    return out


class OnnxEncoder:
    """Model encoder (E4): an ONNX sentence-transformer style model.

    ``embed(text)`` tokenises inside the Arrow batch (whole-word vocabulary lookup,
    vocabulary file read once per worker) and runs the model once per batch;
    ``embed_ids`` takes ``encode_tokens`` output columns instead. ``runner`` may
    replace the ONNX session: ``runner(ids, mask, types) -> float[B, L, H]``.
    """

    never_empty = True       # always a hidden-size vector (a zero vector at worst)

    def __init__(self, model_path: str | None = None, pad_id: int = 0, runner=None,
                 output_name: str = "token_embeddings", vocab_path: str | None = None,
                 max_len: int = C.MAX_SEQ_LEN):
        self.model_path, self.pad_id, self.runner = model_path, int(pad_id), runner
        self.output_name, self.vocab_path, self.max_len = output_name, vocab_path, int(max_len)

    def _runner(self):
        if self.runner is not None:
            return self.runner
        sess = _onnx_session(self.model_path)
        out_name = self.output_name

        def run(i, m, t):
            return sess.run([out_name], {"input_ids": i, "attention_mask": m, "token_type_ids": t})[0]
        return run

    def embed(self, text_col) -> Column:
        enc = self

        @F.arrow_udf(_FLOAT_ARRAY)
        def _run(texts: pa.Array) -> pa.Array:
            vocab = _load_vocab(enc.vocab_path)
            pad = vocab.get(C.PAD, 0)
            ids = encode_batch(texts.to_pylist(), vocab, enc.max_len)
            mask = (ids != pad).astype(np.int64)
            tok = np.asarray(enc._runner()(ids, mask, np.zeros_like(ids)))
            m = np.stack(pool_token_vectors(tok, ids, pad).to_numpy()) if len(ids) else \
                np.zeros((0, tok.shape[-1] if tok.ndim == 3 else 0), np.float32)
            n, h = m.shape
            offsets = pa.array(np.arange(0, n * h + 1, h, dtype=np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(m.ravel(), pa.float32()))

        return _run(_col(text_col))

    def embed_ids(self, input_ids, attention_mask, token_type_ids) -> Column:
        model_path, pad_id, runner, out_name = self.model_path, self.pad_id, self.runner, self.output_name

        @F.pandas_udf(_FLOAT_ARRAY)
        def _run(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            run = runner
            if run is None:
                sess = _onnx_session(model_path)

                def run(i, m, t):
                    return sess.run([out_name], {"input_ids": i, "attention_mask": m,
                                                 "token_type_ids": t})[0]
            for ids_s, mask_s, type_s in it:
                if len(ids_s) == 0:
                    yield pd.Series([], dtype=object)
                    continue
                ids = np.stack(ids_s.to_numpy()).astype(np.int64)
                mask = np.stack(mask_s.to_numpy()).astype(np.int64)
                types = np.stack(type_s.to_numpy()).astype(np.int64)
                yield pool_token_vectors(np.asarray(run(ids, mask, types)), ids, pad_id)

        return _run(_col(input_ids), _col(attention_mask), _col(token_type_ids))


def embed(df: DataFrame, text_col: str, encoder=None, out_col: str = "embedding",
          quantized: bool = True) -> DataFrame:
    """Add ``out_col`` = encoder(text) (E9); quantised to 6 decimals (E7) by default."""
    enc = encoder or HashingEncoder()
    v = enc.embed(F.col(text_col))
    return df.withColumn(out_col, quantize(v) if quantized else v)
