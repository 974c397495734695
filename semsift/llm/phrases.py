"""Collocations from weighted acyclic automata of n-gram counts (operator 11).

Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, pieces into
words at blanks; everything is per language. A symbol is a 64-bit hash of language and
word, so one automaton can hold all languages.

1. *Screen.* Words, pairs and triples are counted into tables of saturating cells, summed
   over tasks a block of cells at a time. A pair whose cell stays under the least count is
   rarer than that itself; so is every phrase around it. The tables only keep work away:
   whatever passes is counted exactly. Their size follows the corpus up to ``MAX_CELLS``;
   where the corpus outgrows that so far that no cell could stay under, they are left out.
2. *Shards.* A task sorts the n-grams of its documents, with words, pairs and windows of
   three to five words apart, and builds count transducers from them in sorted blocks: once
   no later n-gram can pass through a state, the state is frozen, and joined with an equal
   one that is registered already. There is one transducer per prefix range: a range of the
   hashes of an n-gram's first three words (all words of a shorter one).
3. *Union.* The transducers of a range are united and the weights of equal paths summed;
   n-grams under the least count go. Every phrase that reaches it has all its counts in one
   range, and no range depends on how often its words or pairs occur elsewhere.
4. *Composition.* The first and last parts of every candidate are cut out as paths, sent to
   the ranges of their own first words and composed with the transducers there, a layer of
   arcs at a time; the weight of the last arc is the part's count.

Scores are exact: decimals of 38 digits, divided to whole numbers.

A null text counts as empty, a null language as ``und``; ids are not read, repeated rows
count each time. A long text is taken in blocks that end with a piece. An empty table, or
one without a phrase that is frequent enough, gives no rows.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semsift.llm.common import give_back, parallelism, pick, release, stage, text_or_empty
from semsift.llm.wordhash import hash_bytes, mix64, slices, text_bytes

MIN_COUNT, MAX_WORDS = 100, 5
#: Words that place an n-gram in its range.
PREFIX = 3
#: Cells (of one byte in a task, one bit once summed) of each table of the screen.
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 25
TABLES = 3
#: Words of the corpus for each cell; from this many on a screen could not reject anything.
WORDS_PER_CELL, USELESS_LOAD = 64, 100
_CELL_BLOCK = 4096
#: Words of the corpus for each prefix range.
RANGE_WORDS = 1 << 21
#: N-grams of one kind that a task holds, repeats included, before it sums them; it builds
#: transducers when half as many different ones are left.
SHARD_GRAMS = 2_000_000
#: Bytes of one text that are taken at a time.
TEXT_BLOCK = 4 << 20
#: Sorted n-grams that a transducer takes in at a time.
BUILD_BLOCK = 1 << 16

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_NO_WORD = _GAP | _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------------------
# words of a batch (inside tasks)
# ---------------------------------------------------------------------------

class Words:
    """Words of some texts in order: symbols, byte spans and whether a piece starts there."""

    def __init__(self, data: np.ndarray, docs: np.ndarray, seeds: np.ndarray):
        self.data = data = _LOWER[data]
        word = ~_NO_WORD[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = docs[:-1][(docs[:-1] > 0) & (docs[:-1] < len(data))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(docs, self.start, "right") - 1
        breaks = np.cumsum(_BREAK[data], dtype=np.int32)[self.start] if len(data) else np.zeros(0, np.int64)
        self.fresh = np.ones(len(self.start), bool)
        self.fresh[1:] = (breaks[1:] != breaks[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.symbol = mix64(hash_bytes(data, self.start, self.end) ^ seeds[self.doc]) | np.uint64(1)

    def pairs(self) -> np.ndarray:
        """Hash of each word with the next; only where ``~fresh[i + 1]`` it is a pair of a piece."""
        return mix64(self.symbol[:-1] * _STEP + self.symbol[1:])

    def triples(self) -> np.ndarray:
        """Hash of each word with the next two."""
        return mix64(mix64(self.symbol[:-2] * _STEP + self.symbol[1:-1]) * _STEP + self.symbol[2:])

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode()


def seed_of(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _words(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """Words of bounded pieces of a ``(lang, text)`` batch, its languages and their row codes."""
    lang = pc.fill_null(batch.column(0), "und").dictionary_encode()
    names, codes = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
    seeds = np.array([seed_of(n) for n in names], np.uint64)
    for lo, hi in slices(batch.column(1)):
        data, docs = text_bytes(batch.column(1).slice(lo, hi - lo))
        code = codes[lo:hi]
        if len(data) <= 2 * TEXT_BLOCK:
            yield Words(data, docs, seeds[code]), names, code
            continue
        for i in range(hi - lo):                 # a long text: blocks that end behind a piece
            at, end = docs[i], docs[i + 1]
            while at < end:
                to = min(at + TEXT_BLOCK, end)
                while to < end and not _BREAK[data[to - 1]]:
                    ahead = np.flatnonzero(_BREAK[data[to:min(to + TEXT_BLOCK, end)]])
                    to = to + int(ahead[0]) + 1 if len(ahead) else min(to + TEXT_BLOCK, end)
                yield Words(data[at:to], np.array([0, to - at]), seeds[code[i:i + 1]]), names, code[i:i + 1]
                at = to


# ---------------------------------------------------------------------------
# the screen
# ---------------------------------------------------------------------------

def screen(rows: DataFrame, cells: int, least: int) -> np.ndarray:
    """Bits (packed) of the word, pair and triple cells that reach ``least``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TABLES * cells, np.uint8)
        for batch in batches:
            for w, _, _ in _words(batch):
                joined = ~w.fresh[1:]
                for table, hashes in enumerate((w.symbol, w.pairs()[joined], w.triples()[joined[:-1] & joined[1:]])):
                    at, n = np.unique((hashes & np.uint64(cells - 1)).astype(np.int64) + table * cells, return_counts=True)
                    held[at] = np.minimum(held[at] + np.minimum(n, 255), 255)
        held = held.reshape(-1, _CELL_BLOCK)
        for block in np.array_split(np.flatnonzero(held.any(axis=1)), max(1, len(held) // 1024)):
            yield pa.record_batch([pa.array(block.astype(np.int32)), pa.array([held[b].tobytes() for b in block], pa.binary())],
                                  names=["block", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            blocks, bits = [], []
            for block, cells_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(cells_.as_buffer(), np.uint8)
                if block != now:
                    if now is not None:
                        blocks.append(now)
                        bits.append(np.packbits(held >= least).tobytes())
                    now, held = block, np.minimum(own, 255).astype(np.int64)
                else:
                    held += own
            yield pa.record_batch([pa.array(blocks, pa.int32()), pa.array(bits, pa.binary())], names=["block", "bits"])
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(held >= least).tobytes()], pa.binary())],
                                  names=["block", "bits"])

    summed = rows.mapInArrow(count, "block int, cells binary").repartition(parallelism(rows.sparkSession), "block") \
        .sortWithinPartitions("block").mapInArrow(total, "block int, bits binary")
    bits = np.zeros((TABLES * cells // _CELL_BLOCK, _CELL_BLOCK // 8), np.uint8)
    table = summed.toArrow()                    # bounded: the table's own size
    for block, own in zip(table.column("block").to_pylist(), table.column("bits").to_pylist()):
        bits[block] = np.frombuffer(own, np.uint8)
    return bits.reshape(-1)


def _passes(bits: np.ndarray | None, hashes: np.ndarray, table: int) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    cells = len(bits) * 8 // TABLES
    cell = (hashes & np.uint64(cells - 1)).astype(np.int64) + table * cells
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


# ---------------------------------------------------------------------------
# count transducers
# ---------------------------------------------------------------------------

def _sorted_rows(rows: np.ndarray) -> np.ndarray:
    return np.lexsort(rows.T[::-1]) if rows.shape[1] else np.zeros(len(rows), np.int64)


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return np.flatnonzero(new)


class CountTransducer:
    """An acyclic automaton over symbols; the count of an n-gram is the weight of its path's
    last arc (0 where that prefix is only passed through). Layer ``d`` holds the arcs from
    states of depth ``d`` to states of depth ``d + 1``, by state and symbol; target -1 ends.
    Equal states are one state."""

    def __init__(self, depth: int):
        self.parts = [{"degree": [], "symbol": [], "weight": [], "target": []} for _ in range(depth)]
        self.register = [(np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)) for _ in range(depth)]
        self.size = [0] * depth                 # states that each layer's arcs leave from

    @property
    def depth(self) -> int:
        return len(self.parts)

    # -- building ---------------------------------------------------------

    def add(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Adds a sorted block of n-grams as a prefix tree: per depth, each node's parent (by
        place in the level before; ascending), symbol and weight. No later block may pass
        through a node of this one, so all its states are frozen here."""
        target = np.full(len(levels[-1][0]), -1, np.int64) if levels else np.zeros(0, np.int64)
        for d in range(len(levels) - 1, -1, -1):
            parent, symbol, weight = levels[d]
            n = len(levels[d - 1][0]) if d else 1
            if d == 0:                           # the root's arcs only grow in number
                self._append(0, np.zeros(0, np.int64), symbol, weight, target)
                break
            degree = np.bincount(parent, minlength=n)
            above = np.full(n, -1, np.int64)
            with np.errstate(over="ignore"):
                arc = mix64(symbol + mix64(weight.astype(np.uint64) * _STEP + (target + 2).astype(np.uint64)))
                own = np.flatnonzero(degree)
                first = np.concatenate([[0], np.cumsum(degree[own])[:-1]]).astype(np.int64)
                sign = np.stack([np.add.reduceat(arc, first), np.add.reduceat(mix64(arc), first)], axis=1) \
                    if len(own) else np.zeros((0, 2), np.uint64)
            above[own] = self._registered(d, sign, degree[own], first, symbol, weight, target)
            target = above

    def _registered(self, d, sign, degree, first, symbol, weight, target) -> np.ndarray:
        """State numbers for signatures of arc lists: registered ones, or new ones."""
        known, numbers = self.register[d]
        both = np.concatenate([known, sign])
        _, at, inverse = np.unique(both, axis=0, return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        new = at >= len(known)
        fresh = np.sort(at[new]) - len(known)
        number = np.empty(len(at), np.int64)
        number[~new] = numbers[at[~new]]
        number[new] = self.size[d] + np.searchsorted(fresh, at[new] - len(known))
        self.size[d] += len(fresh)
        self.register[d] = (both[at], number)
        take = np.repeat(first[fresh] - np.concatenate([[0], np.cumsum(degree[fresh])[:-1]]).astype(np.int64),
                         degree[fresh]) + np.arange(int(degree[fresh].sum())) if len(fresh) else np.zeros(0, np.int64)
        self._append(d, degree[fresh], symbol[take], weight[take], target[take])
        return number[inverse[len(known):]]

    def _append(self, d, degree, symbol, weight, target) -> None:
        for name, values in zip(("degree", "symbol", "weight", "target"), (degree, symbol, weight, target)):
            self.parts[d][name].append(values)

    # -- as bytes ---------------------------------------------------------

    def pack(self) -> bytes:
        out = [np.array([self.depth], "<i8").tobytes()]
        for d, part in enumerate(self.parts):
            degree, symbol, weight, target = (np.concatenate([np.zeros(0, np.int64), *part[k]]) if k != "symbol" else
                                              np.concatenate([np.zeros(0, np.uint64), *part[k]])
                                              for k in ("degree", "symbol", "weight", "target"))
            if d == 0:
                degree = np.array([len(symbol)])
            for values in (degree, weight, target + 1):
                kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(values) or values.max() <= np.iinfo(k).max)
                out += [kind.encode(), np.array([len(values)], "<i8").tobytes(), values.astype(kind).tobytes()]
            out.append(symbol.astype("<u8").tobytes())
        return b"".join(out)


def unpack(data: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Layers of a packed transducer: ``(offsets of the states' arcs, symbol, weight, target)``."""
    depth, at, layers = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for _ in range(depth):
        arrays = []
        for _ in range(3):
            kind, n = data[at:at + 3].decode(), int(np.frombuffer(data, "<i8", 1, at + 3)[0])
            values = np.frombuffer(data, kind, n, at + 11)
            at += 11 + values.nbytes
            arrays.append(values.astype(np.int64))
        degree, weight, target = arrays
        symbol = np.frombuffer(data, "<u8", len(weight), at)
        at += symbol.nbytes
        layers.append((np.concatenate([[0], np.cumsum(degree)]), symbol, weight, target - 1))
    return layers


def all_paths(layers) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per depth, the symbols of every path, sorted, and its weight."""
    rows, state, out = np.zeros((1, 0), np.uint64), np.zeros(1, np.int64), []
    for offsets, symbol, weight, target in layers:
        live = np.flatnonzero(state >= 0)
        degree = offsets[state[live] + 1] - offsets[state[live]]
        arc = np.repeat(offsets[state[live]] - (np.cumsum(degree) - degree), degree) + np.arange(int(degree.sum()))
        rows = np.column_stack([rows[live].repeat(degree, axis=0), symbol[arc]]).astype(np.uint64)
        out.append((rows, weight[arc]))
        state = target[arc]
    return out


def compose(layers, paths: np.ndarray) -> np.ndarray:
    """Weights of the last arcs of ``paths`` (all of one length) in a transducer, 0 where it
    has no such path. Path states meet the transducer's a layer at a time."""
    state = np.zeros(len(paths), np.int64)
    found = np.zeros(len(paths), np.int64)
    for d in range(paths.shape[1]):
        if d >= len(layers):
            return np.zeros(len(paths), np.int64)
        offsets, symbol, weight, target = layers[d]
        alphabet = np.unique(symbol)
        source = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        arcs = source * len(alphabet) + np.searchsorted(alphabet, symbol)
        rank = np.searchsorted(alphabet, paths[:, d])
        known = (rank < len(alphabet)) & (state >= 0)
        known[known] = alphabet[rank[known]] == paths[known, d]
        place = np.minimum(np.searchsorted(arcs, state * len(alphabet) + rank), max(len(arcs) - 1, 0))
        hit = known.copy()
        hit[known] = arcs[place[known]] == state[known] * len(alphabet) + rank[known]
        state, found = np.where(hit, target[place] if len(arcs) else -1, -1), np.where(hit, weight[place] if len(arcs) else 0, 0)
    return found


def _levels(rows: np.ndarray, counts: np.ndarray, final: int, summed: bool):
    """The prefix tree of sorted, distinct, zero-padded rows; prefixes shorter than ``final``
    weigh nothing. A prefix counts what its rows count together, or if they are ``summed``
    what its own row, the first of them, says."""
    levels, place = [], np.zeros(len(rows), np.int64)
    for d in range(rows.shape[1]):
        live = np.flatnonzero(rows[:, d])
        if not len(live):
            break
        at = _starts(np.column_stack([place[live].astype(np.uint64), rows[live, d]]))
        weight = np.zeros(len(at), np.int64) if d + 1 < final else counts[live][at] if summed \
            else np.add.reduceat(counts[live], at)
        levels.append((place[live][at], rows[live, d][at], weight))
        node = np.zeros(len(live), np.int64)
        node[at[1:]] = 1
        place = np.full(len(rows), -1, np.int64)
        place[live] = np.cumsum(node)
        keep = place >= 0
        rows, counts, place = rows[keep], counts[keep], place[keep]
    return levels


def build_transducer(rows: np.ndarray, counts: np.ndarray, final: int, summed: bool = False) -> CountTransducer:
    """From sorted, distinct, zero-padded n-grams, a block of whole first symbols at a time."""
    out, at = CountTransducer(rows.shape[1]), 0
    edges = np.append(np.flatnonzero(np.diff(rows[:, 0], prepend=np.uint64(0)) != 0), len(rows))
    while at < len(rows):
        to = int(edges[min(np.searchsorted(edges, at + BUILD_BLOCK), len(edges) - 1)])
        out.add(_levels(rows[at:to], counts[at:to], final, summed))
        at = to
    return out


def prefix_range(rows: np.ndarray, ranges: int) -> np.ndarray:
    """The range of the hash of an n-gram's first words; ``ranges`` is a power of two."""
    h = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for d in range(min(PREFIX, rows.shape[1])):
            h = mix64(h * _STEP + rows[:, d])
    return (h >> np.uint64(65 - ranges.bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(rows), np.int64)


def _summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, distinct rows and the sums of their counts."""
    order = _sorted_rows(rows)
    rows, counts = rows[order], counts[order]
    at = _starts(rows)
    return rows[at], np.add.reduceat(counts, at) if len(at) else counts


class Grams:
    """N-grams of one kind in a task, summed whenever many have come together."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: np.ndarray) -> bool:
        """Whether so many different n-grams are held that they should go out."""
        if len(rows):
            self.parts.append((rows, np.ones(len(rows), np.int64)))
            self.size += len(rows)
        if self.size > SHARD_GRAMS:
            self.parts = [_summed(*self._all())]
            self.size = len(self.parts[0][0])
        return self.size > SHARD_GRAMS // 2

    def _all(self):
        rows, counts = zip(*self.parts)
        return np.concatenate(rows), np.concatenate(counts)

    def transducers(self, kind: int, ranges: int) -> Iterator[tuple[int, bytes]]:
        """``(range, packed transducer)`` of what is held, which is let go."""
        if not self.parts:
            return
        rows, counts = self._all()
        self.parts, self.size = [], 0
        keyed, counts = _summed(np.column_stack([prefix_range(rows, ranges).astype(np.uint64), rows]), counts)
        edge = np.append(np.flatnonzero(np.diff(keyed[:, 0].astype(np.int64), prepend=-1)), len(keyed))
        for a, b in zip(edge[:-1], edge[1:]):
            yield int(keyed[a, 0]), build_transducer(keyed[a:b, 1:], counts[a:b], kind).pack()


# ---------------------------------------------------------------------------
# Spark operators
# ---------------------------------------------------------------------------

SHARDS = "kind int, range int, automaton binary, symbol long, lang string, word string, n long"
#: Rows of ``SHARDS`` beside transducers: languages' word totals, and words by symbol.
TOTAL, WORD = 0, -1


def shard_rows(rows: DataFrame, bits: np.ndarray | None, ranges: int, max_words: int = MAX_WORDS) -> DataFrame:
    """Per task: count transducers by prefix range, word totals, and the words of its pairs."""
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def batch(kind, range_=(), automaton=(), symbol=(), lang=(), word=(), n=()) -> pa.RecordBatch:
        size = max(map(len, (range_, symbol, lang)))
        cols = [([kind] * size if isinstance(kind, int) else kind, pa.int32())] + [
            (list(c) if len(c) else [None] * size, t) for c, t in
            ((range_, pa.int32()), (automaton, pa.binary()), (symbol, pa.int64()), (lang, pa.string()),
             (word, pa.string()), (n, pa.int64()))]
        return pa.record_batch([pa.array(c, t) for c, t in cols], names=[c.split()[0] for c in SHARDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_ = sent.value
        grams = {k: Grams() for k in range(1, PREFIX + 1)}
        totals: dict[str, int] = {}
        words: dict[int, tuple[str, str]] = {}

        def flush():
            for kind, held in grams.items():
                out = []
                for entry in held.transducers(kind, ranges):
                    out.append(entry)
                    if len(out) == 64:
                        yield batch(kind, *zip(*out))
                        out = []
                if out:
                    yield batch(kind, *zip(*out))
            if words:
                symbols = np.array(list(words), np.uint64)
                yield batch(WORD, prefix_range(symbols[:, None], ranges).tolist(), symbol=symbols.view(np.int64).tolist(),
                            lang=[x[0] for x in words.values()], word=[x[1] for x in words.values()])
            words.clear()

        for rows_ in batches:
            for w, names, codes in _words(rows_):
                n = len(w.symbol)
                for code, count in zip(*np.unique(codes[w.doc], return_counts=True)):
                    totals[names[code]] = totals.get(names[code], 0) + int(count)
                if not n:
                    continue
                pair, triple = np.zeros(n + max_words, bool), np.zeros(n + max_words, bool)
                pair[:n - 1] = ~w.fresh[1:] & _passes(bits_, w.pairs(), 1)
                triple[:max(n - 2, 0)] = pair[:max(n - 2, 0)] & pair[1:max(n - 1, 1)] & _passes(bits_, w.triples(), 2)
                at = np.flatnonzero(pair[:n])
                padded = np.append(w.symbol, np.zeros(max_words, np.uint64))
                full = grams[1].add(w.symbol[_passes(bits_, w.symbol, 0)][:, None])
                full |= grams[2].add(np.column_stack([padded[at], padded[at + 1]]))
                at = np.flatnonzero(triple[:n])
                cols, alive = [padded[at], padded[at + 1], padded[at + 2]], np.ones(len(at), bool)
                for d in range(PREFIX, max_words):
                    alive = alive & triple[at + d - 2]
                    cols.append(np.where(alive, padded[at + d], np.uint64(0)))
                full |= grams[3].add(np.column_stack(cols))
                part = pair[:n].copy()
                part[1:] |= pair[:n - 1]
                at = np.flatnonzero(part)
                symbols, first = np.unique(w.symbol[at], return_index=True)
                for symbol, i in zip(symbols.tolist(), at[first].tolist()):
                    if symbol not in words:
                        words[symbol] = names[codes[w.doc[i]]], w.text(i)
                if full or len(words) > SHARD_GRAMS // 4:
                    yield from flush()
        yield from flush()
        if totals:
            yield batch(TOTAL, [0] * len(totals), lang=list(totals), n=list(totals.values()))
        give_back()

    return rows.mapInArrow(run, SHARDS)


def _as_bytes(rows: np.ndarray) -> pa.Array:
    """Symbols of each row as big-endian bytes (so that parts are byte ranges)."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows.astype(">u8"))], pa.binary())


def union_shards(shards: DataFrame, least: int) -> DataFrame:
    """The shards' rows by kind and range: transducers united with the weights of equal paths
    summed, without n-grams rarer than ``least``; word totals summed; words once."""
    names = [c.split()[0] for c in SHARDS.split(", ")]

    def unite(rows: pa.Table) -> pa.Table:
        kind, number = rows.column("kind")[0].as_py(), rows.column("range")[0].as_py()

        def out(size: int, **cols) -> pa.Table:
            cols |= {"kind": pa.array([kind] * size, pa.int32()), "range": pa.array([number] * size, pa.int32())}
            return pa.table([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(size, f.type) for f in rows.schema],
                            rows.schema)

        if kind == TOTAL:
            summed = rows.group_by("lang").aggregate([("n", "sum")])
            return out(summed.num_rows, lang=summed["lang"], n=summed["n_sum"])
        if kind == WORD:
            once = rows.group_by("symbol").aggregate([("lang", "min"), ("word", "min")])
            return out(once.num_rows, symbol=once["symbol"], lang=once["lang_min"], word=once["word_min"])
        by_depth: dict[int, list] = {}
        for automaton in rows.column("automaton"):
            for d, (paths, weight) in enumerate(all_paths(unpack(automaton.as_py())), 1):
                if d >= kind and len(paths):
                    by_depth.setdefault(d, []).append((paths, weight))
        grams, counts, width = [], [], max(by_depth, default=0)
        for d, parts in by_depth.items():
            paths, weight = _summed(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]))
            keep = weight >= least
            grams.append(np.pad(paths[keep], ((0, 0), (0, width - d))))
            counts.append(weight[keep])
        if not sum(map(len, grams)):
            return out(0)
        grams, counts = np.concatenate(grams), np.concatenate(counts)
        order = _sorted_rows(grams)
        return out(1, automaton=pa.array([build_transducer(grams[order], counts[order], kind, summed=True).pack()], pa.binary()))

    return shards.select(*names).groupBy("kind", "range").applyInArrow(unite, SHARDS)


def candidates_of(counts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``(phrase binary, a long)``: every counted n-gram of two words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, automaton in zip(batch.column(0).to_pylist(), batch.column(1)):
                for d, (paths, weight) in enumerate(all_paths(unpack(automaton.as_py())), 1):
                    if d >= max(kind, 2) and len(paths):
                        yield pa.record_batch([_as_bytes(paths), pa.array(weight)], names=["phrase", "a"])

    return counts.select("kind", "automaton").mapInArrow(run, "phrase binary, a long")


def part_counts(parts: DataFrame, counts: DataFrame, ranges: int) -> DataFrame:
    """``(part, f)`` of distinct parts, composed with the transducers of their ranges."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            size = np.array([len(v) // 8 for v in values], np.int64)
            where = np.zeros(len(values), np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                rows = np.frombuffer(b"".join(values[i] for i in at), ">u8").reshape(-1, n).astype(np.uint64)
                where[at] = prefix_range(rows, ranges)
            yield pa.record_batch([pa.array(np.minimum(size, PREFIX), pa.int32()), pa.array(where, pa.int32()),
                                   batch.column(0)], names=["kind", "range", "part"])

    def look_up(asked: pa.Table, held: pa.Table) -> pa.Table:
        values = asked.column("part").to_pylist()
        f = np.zeros(len(values), np.int64)
        for automaton in held.column("automaton"):
            layers = unpack(automaton.as_py())
            for n in {len(v) // 8 for v in values}:
                at = [i for i, v in enumerate(values) if len(v) // 8 == n]
                rows = np.frombuffer(b"".join(values[i] for i in at), ">u8").reshape(-1, n).astype(np.uint64)
                f[at] += compose(layers, rows)
        if len(f) and not f.all():
            raise ValueError("a part of a counted phrase has no count")
        return pa.table({"part": asked.column("part"), "f": pa.array(f)})

    placed = parts.select("part").distinct().mapInArrow(place, "kind int, range int, part binary")
    return placed.groupBy("kind", "range").cogroup(counts.groupBy("kind", "range")) \
        .applyInArrow(look_up, "part binary, f long")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = MIN_COUNT,
                 max_words: int = MAX_WORDS, top: int = 2000, absorb_percent: int = 100,
                 cells: int | None = None) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``cells``: size of the screen (a power of two); by default it follows the corpus."""
    if not 3 <= max_words <= 8 or least < 1 or least > 255:
        raise ValueError("phrases of up to 3 to 8 words, counts of 1 to 255")
    spark = docs.sparkSession
    rows = pick(docs, lang=lang_col, text=text_col).select(F.col("lang").cast("string").alias("lang"),
                                                           text_or_empty("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_words = size // 6 + 1                      # for sizes of tables only
    power = lambda x: 1 << max(0, int(x) - 1).bit_length()
    load_cells = min(MAX_CELLS, max(MIN_CELLS, power(n_words / WORDS_PER_CELL)))
    cells = cells or (load_cells if n_words / load_cells < USELESS_LOAD else 0)
    ranges = min(1 << 16, power(max(n_words / RANGE_WORDS, 1)))
    bits = screen(rows, cells, least) if cells else None
    united = stage(union_shards(shard_rows(rows, bits, ranges, max_words), least), "phrase-counts")
    counts = united.where("kind > 0").select("kind", "range", "automaton")

    cands = stage(candidates_of(counts, max_words), "phrase-candidates")
    words = F.length("phrase") / 8
    piece = lambda start, n: F.substring("phrase", start * 8 + 1, n * 8)
    # phrases inside a longer one that occurs (nearly) as often
    inner = cands.where(words > 2).select("phrase", "a", F.explode(F.sequence(F.lit(2), words.cast("int") - 1)).alias("m")) \
        .select("phrase", "a", "m", F.explode(F.sequence(F.lit(0), words.cast("int") - F.col("m"))).alias("at")) \
        .select(piece(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("phrase").agg(F.max("a").alias("longer"))
    kept = cands.join(inner, "phrase", "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < absorb_percent * F.col("a"))).select("phrase", "a")
    cuts = stage(kept.select("phrase", "a", F.explode(F.sequence(F.lit(1), words.cast("int") - 1)).alias("k"))
                 .select("phrase", "a", "k", piece(F.lit(0), F.col("k")).alias("first"),
                         piece(F.col("k"), words.cast("int") - F.col("k")).alias("rest")), "phrase-cuts")
    found = stage(part_counts(cuts.select(F.explode(F.array("first", "rest")).alias("part")), counts, ranges),
                  "phrase-parts")
    cuts = cuts.join(found.withColumnsRenamed({"part": "first", "f": "l"}), "first") \
        .join(found.withColumnsRenamed({"part": "rest", "f": "r"}), "rest")

    symbol = F.conv(F.hex(piece(F.col("at"), F.lit(1))), 16, -10).cast("long")
    spelled = united.where(F.col("kind") == WORD).select("symbol", "lang", "word")
    phrases = kept.select("phrase", F.explode(F.sequence(F.lit(0), words.cast("int") - 1)).alias("at")) \
        .withColumn("symbol", symbol).join(spelled, "symbol") \
        .groupBy("phrase").agg(F.min("lang").alias("lang"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("spelling"))
    totals = united.where(F.col("kind") == TOTAL).select("lang", "n")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    joined = cuts.join(phrases, "phrase").join(totals, "lang").select(
        "*", (wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)")).alias("over"), (wide("l") * wide("r")).alias("under"))
    scored = joined.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "spelling", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    out = best.select("lang", F.col("spelling").alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                      "n", F.col("cut.score").cast("long").alias("score")) \
        .withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    result = stage(out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrase-result")
    release(united, cands, cuts, found)
    return result
