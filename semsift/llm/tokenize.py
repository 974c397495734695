"""Token ids of whole Arrow text columns with a byte-level BPE tokenizer file.

Byte-level BPE splits a text before merging, and never across the border in front of a
word (with the one space before it). So a slice of texts is cut into such units on its
byte buffer, every distinct unit is encoded once, and documents are put together from
the units' ids. Texts in which the cut could differ from the tokenizer's own (white
space outside ASCII, control characters, special-token strings) are encoded whole.
Helpers for use inside tasks.
"""
from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from semsift.llm.wordhash import hash_bytes, text_bytes

#: Characters that the tokenizer may take for white space, beyond the six ASCII ones.
ODD_SPACE = "[\x1c-\x1f\x85  ᠎ -​    　﻿]"
#: Units kept between slices, some 40 bytes each; beyond it a task starts over (ids stay
#: the same).
MAX_KNOWN = 400_000


def unit_bounds(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Starts of the units of the texts ``data[docs[i]:docs[i + 1]]``; units cover every byte."""
    n = len(data)
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    begins = np.zeros(n, dtype=bool)
    inner = docs[:-1][docs[:-1] < n]
    begins[inner] = True
    change = np.zeros(n, dtype=bool)
    change[1:] = space[1:] != space[:-1]
    change |= begins
    runs = np.flatnonzero(change)
    run_space = space[runs]
    ends = np.append(runs[1:], n)
    # a word run that follows white space of its own document takes over a last space;
    # any other last white-space character stands alone
    at = np.flatnonzero(~run_space[1:] & run_space[:-1] & ~begins[runs[1:]]) + 1
    last = runs[at] - 1
    glued = data[last] == 0x20
    starts = np.ones(n + 1, dtype=bool)
    starts[:] = False
    starts[runs] = True
    starts[runs[at][glued]] = False
    starts[last] = True
    return np.flatnonzero(starts[:n])


def _merge_ranks(spec: dict) -> dict[bytes, int]:
    """Byte strings with their ids, from a byte-level BPE tokenizer file whose ids follow
    the order of its merges (so that an id is also a merge rank)."""
    model = spec["model"]
    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)):
        raise ValueError("the ids of this tokenizer do not follow its merges")
    # the byte alphabet: printable Latin-1 stands for itself, other bytes follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(byte[c] for c in word): k for word, k in vocab.items() if word not in special}


#: The word pattern that byte-level pre-tokenizers use when they split by themselves.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class UnitTokenizer:
    """``encode(texts)`` gives ``(ids, offsets)`` for an Arrow text column.

    ``source`` is the tokenizer file's content. The ids are those of the ``tokenizers``
    library. Units are merged with the same merges by ``tiktoken``, which is several
    times faster on rare words; whole texts go through ``tokenizers``."""

    def __init__(self, source: str, max_known: int = MAX_KNOWN):
        import tiktoken
        spec = json.loads(source)
        self.source, self.tokenizer = source, None
        self.merge = tiktoken.Encoding("unit", pat_str=PATTERN, mergeable_ranks=_merge_ranks(spec),
                                       special_tokens={})
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.max_known = max_known
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)      # sorted unit hashes
        self.begin = np.zeros(0, np.uint32)      # places in ids, in the order of ``known``
        self.size = np.zeros(0, np.uint32)
        self.ids = np.zeros(0, np.uint32)        # in the order in which units were met

    def _encode_whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.tokenizer is None:      # few tasks need it, and it takes as much memory as the merges
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_str(self.source)
        return _flat([self.tokenizer.encode(t, add_special_tokens=False).ids for t in texts])

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Adds units (by sorted hash) to what is known; ids that are known stay where they are."""
        ids, at = _flat(list(map(self.merge.encode_ordinary, units)))
        place = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, place, hashes)
        self.begin = np.insert(self.begin, place, (at[:-1] + len(self.ids)).astype(np.uint32))
        self.size = np.insert(self.size, place, np.diff(at).astype(np.uint32))
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        for special in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        odd = np.asarray(pc.fill_null(odd, False), dtype=bool)
        plain = pc.if_else(pa.array(~odd), texts, "") if odd.any() else texts
        data, docs = text_bytes(plain)
        starts = unit_bounds(data, docs)
        ends = np.append(starts[1:], len(data))
        hashes = hash_bytes(data, starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        new = (place == len(self.known)) | (self.known[np.minimum(place, len(self.known) - 1)] != distinct) \
            if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.known) + int(new.sum()) > self.max_known:   # start over with this slice's units
                self._forget()
                new = np.ones(len(distinct), bool)
            buf = data.tobytes()
            units = [buf[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            self._learn(distinct[new], units)
            place = np.searchsorted(self.known, distinct)
        row = place[inverse]
        sizes = self.size[row].astype(np.int64)
        ids = self.ids[_ranges(self.begin[row].astype(np.int64), sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = total[np.searchsorted(starts, docs, "left")]
        if odd.any():
            whole, whole_at = self._encode_whole(pc.filter(texts, pa.array(odd)).to_pylist())
            parts, k = [], 0
            for i in range(len(texts)):
                if odd[i]:
                    parts.append(whole[whole_at[k]:whole_at[k + 1]])
                    k += 1
                else:
                    parts.append(ids[at[i]:at[i + 1]])
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, at


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
    return ids, np.concatenate([[0], np.cumsum(sizes)])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of the ranges ``begin[i] .. begin[i] + size[i]``, one after the other."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.arange(total) - np.repeat(before - begin, size)
