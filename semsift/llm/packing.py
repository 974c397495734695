"""Sum-of-squares online packing of token streams (operator 9).

Each task tokenizes its documents and packs them as they come. Whole windows cut from a
long document are sequences of their own; the rest of a document goes to the open window
whose fill level keeps the sum of squared level counts smallest. The counts live in one
array with an entry per fill level, so placing a document looks at one bounded array,
whatever the corpus holds. Windows still open when a task ends are cut at powers of two,
which need no padding. Nothing is shuffled; a task keeps one Arrow batch and its open
windows.

A null or empty text is the end-of-document id alone. Repeated rows are packed as
separate documents; a null id is kept. An empty table gives no pieces. Sequence ids are
unique over the result: the task's partition number and a running number.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semsift.llm.common import give_back, pick
from semsift.llm.tokenize import UnitTokenizer
from semsift.llm.wordhash import slices

WINDOW = 1024
#: A window this close to full is left as it is when its task ends.
NEARLY_FULL = 0.97
#: Bytes of text that a task tokenizes at once: what that takes is some forty times as much.
SLICE_BYTES = 1 << 19

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class SumOfSquares:
    """Open windows by fill level; ``count[level]`` is how many stand at that level."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def place(self, piece: tuple, size: int) -> list | None:
        """Adds the piece to a window; returns the window's pieces when it is full."""
        levels = self.window - size  # the highest level with room
        c = self.count
        # change of sum(count^2) for a move from level h to h + size; level 0 is a new
        # window, and neither it nor the full level is counted
        change = 2 * c[size:self.window + 1] + 1
        change[levels] = 0
        change[1:] -= 2 * c[1:levels + 1] - 1
        change[1:][c[1:levels + 1] == 0] = np.iinfo(np.int64).max
        level = levels - int(np.argmin(change[::-1]))  # the fuller window wins ties
        pieces = self.open[level].pop() if level else []
        if level:
            c[level] -= 1
        pieces.append((level, piece))
        to = level + size
        if to == self.window:
            return pieces
        self.open[to].append(pieces)
        c[to] += 1
        return None

    def rest(self) -> Iterator[tuple[int, list]]:
        for level, windows in enumerate(self.open):
            for pieces in windows:
                yield level, pieces


def _cut(level: int, pieces: list, window: int) -> Iterator[list]:
    """A window of ``level`` ids as sequences whose lengths are powers of two."""
    if level >= NEARLY_FULL * window or level & (level - 1) == 0:
        yield pieces
        return
    edges, at = [], 0
    for bit in reversed(range(level.bit_length())):
        if level >> bit & 1:
            edges.append((at, at + (1 << bit)))
            at += 1 << bit
    for lo, hi in edges:
        part = []
        for offset, (doc, start, ids, total) in pieces:
            a, b = max(lo, offset), min(hi, offset + len(ids))
            if a < b:
                part.append((a - lo, (doc, start + a - offset, ids[a - offset:b - offset], total)))
        yield part


class _Rows:
    """Output columns of one batch."""

    def __init__(self, first_sequence: int):
        self.next_sequence = first_sequence
        self.rows: list[tuple] = []

    def add(self, pieces: list) -> None:
        for offset, (doc, start, ids, total) in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                              total, self.next_sequence, offset))
        self.next_sequence += 1

    def take(self) -> pa.RecordBatch:
        names = [c.split()[0] for c in PIECES.split(", ")]
        cols = list(zip(*self.rows)) or [()] * len(names)
        self.rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=names)


def token_slices(encode, batch: pa.RecordBatch, end_id: int) -> Iterator[Iterator[tuple[int | None, np.ndarray]]]:
    """The documents of an Arrow batch with their ids, a slice of its texts at a time."""
    texts = pc.fill_null(batch.column(1), "")
    for lo, hi in slices(texts, SLICE_BYTES):
        ids, at = encode(texts.slice(lo, hi - lo))
        numbers = batch.column(0).slice(lo, hi - lo).to_pylist()
        yield ((number, np.append(ids[a:b], np.uint32(end_id))) for number, a, b in zip(numbers, at, at[1:]))
        del ids, at     # before the next slice is tokenized


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from windows(batches)
        finally:
            give_back()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = UnitTokenizer(source.value)        # of this task; its units go with it
        give_back()                                 # what reading the file took
        packer, out = SumOfSquares(window), _Rows(TaskContext.get().partitionId() << 36)
        for batch in batches:
            for docs_of_slice in token_slices(encode, batch, end_id):
                for number, doc in docs_of_slice:
                    whole = len(doc) // window * window
                    for start in range(0, whole, window):
                        out.add([(0, (number, start, doc[start:start + window], len(doc)))])
                    if whole < len(doc):
                        rest = doc[whole:].copy() if whole else doc     # not the whole document with it
                        full = packer.place((number, whole, rest, len(doc)), len(rest))
                        if full:
                            out.add(full)
                yield out.take()
            batch = None        # before the next one is read
        for level, pieces in packer.rest():
            for part in _cut(level, pieces, window):
                out.add(part)
        yield out.take()

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, PIECES)
