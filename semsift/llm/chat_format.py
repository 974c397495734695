"""Chat formatting with offset-aligned loss masks (operator 5).

A conversation is rendered whole from a template that marks turns, encoded once with
offsets, and the sorted spans of its assistant texts are intersected with the sorted
token spans by binary search: a token bears loss if it touches such a span, and its
offsets are clipped to it.

Control strings inside texts are escaped reversibly: a backslash goes in front of every
backslash, ``###`` and ``</turn>``. Rows of a conversation arrive sorted in one task
and stream through it. A conversation of more than ``section_chars`` rendered characters
is put out as several sections, cut between turns, so memory stays bounded.

Null texts and roles count as empty; rows are ordered by turn (nulls first), then role
and text, so ties and repeated rows have a fixed order and all appear. Rows with a null
conversation id form one conversation. An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semsift.llm.common import parallelism, pick

# the template
OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_TURN_END = re.compile(r"\\(?:\\|###|</turn>)|</turn>")
LOSS_ROLE = "assistant"
SECTION_CHARS = 1 << 20

SECTIONS = ("conv_id long, section long, n_turns long, formatted string, ids array<int>, "
            "starts array<int>, ends array<int>, loss array<boolean>")
READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long, n_tokens long, n_loss_tokens long")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> tuple[str, str, str]:
    """Header, body and footer of a turn; the role stays on the header's line."""
    return OPEN + escape(role).replace("\n", "\\n") + "\n", escape(text), CLOSE + "\n"


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts back from a rendered section."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        role = re.sub(r"\\(\\|###|</turn>|n)", lambda m: "\n" if m[1] == "n" else m[1],
                      formatted[at + len(OPEN):line])
        end = next(m for m in _TURN_END.finditer(formatted, line + 1) if m[0] == CLOSE)
        yield role, unescape(formatted[line + 1:end.start()])
        at = end.end() + 1


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Marks the tokens that touch a span and clips their offsets to it, in place."""
    loss = np.zeros(len(starts), dtype=bool)
    if spans:
        lo = np.array([a for a, _ in spans])
        hi = np.array([b for _, b in spans])
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        for a, b, i, j in zip(lo, hi, first, last):
            loss[i:j] = True
            np.clip(starts[i:j], a, b, out=starts[i:j])
            np.clip(ends[i:j], a, b, out=ends[i:j])
    return loss


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())


def format_conversations(turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id",
                         turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         loss_role: str = LOSS_ROLE, section_chars: int = SECTION_CHARS) -> DataFrame:
    """One row per section: its text, token ids, token offsets and loss mask."""
    spark = turns.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        source = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(source.value)
        tokenizer.encode_special_tokens = True
        out, chars = [], 0

        def section(conv, number, parts, spans, n_turns):
            text = "".join(parts)
            enc = tokenizer.encode(text, add_special_tokens=False)
            offsets = np.array(enc.offsets, dtype=np.int32).reshape(-1, 2)
            starts, ends = offsets[:, 0].copy(), offsets[:, 1].copy()
            loss = loss_mask(starts, ends, spans)
            return conv, number, n_turns, text, np.array(enc.ids, np.int32), starts, ends, loss

        def rows():
            conv, number, parts, spans, size, n = None, 0, [], [], 0, 0
            for key, role, text in _turns(batches):
                head, body, foot = render_turn(role or "", text or "")
                if n and (key != conv or size + len(head) + len(body) + len(foot) > section_chars):
                    yield section(conv, number, parts, spans, n)
                    number, parts, spans, size, n = number + 1 if key == conv else 0, [], [], 0, 0
                conv = key
                if role == loss_role and body:
                    spans.append((size + len(head), size + len(head) + len(body)))
                parts += (head, body, foot)
                size, n = size + len(head) + len(body) + len(foot), n + 1
            if n:
                yield section(conv, number, parts, spans, n)

        def batch_of(rows_):
            cols = list(zip(*rows_))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()),
                     pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            names = [c.split()[0] for c in SECTIONS.split(", ")]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for row in rows():
            out.append(row)
            chars += len(row[3])
            if chars >= section_chars:
                yield batch_of(out)
                out, chars = [], 0
        if out:
            yield batch_of(out)

    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    ordered = (rows.repartition(parallelism(spark), "conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "text")
               .select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text"))
    return ordered.mapInArrow(run, SECTIONS)


def read_back(sections: DataFrame) -> DataFrame:
    """Digests per conversation, from the formatted output alone. ``sections`` as
    ``format_conversations`` puts them out: sections of a conversation follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ_BACK.split(", ")]
        kinds = [pa.string() if "sha256" in n else pa.int64() for n in names]
        done, state = [], None

        def close(s):
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6], s[7])

        def out(rows_):
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows_), kinds)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                conv, number, text = (batch.column(k)[i].as_py() for k in (0, 1, 3))
                starts, ends, loss = (np.asarray(batch.column(k)[i].values.to_numpy(zero_copy_only=False))
                                      for k in (5, 6, 7))
                if number == 0:
                    if state:
                        done.append(close(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, body in parse_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                a, b = starts[loss], ends[loss]
                if len(a):
                    reach = np.maximum.accumulate(b)
                    cut = np.flatnonzero(a[1:] > reach[:-1]) + 1
                    for x, y in zip(a[np.append(0, cut)], reach[np.append(cut - 1, len(a) - 1)]):
                        piece = unescape(text[x:y])
                        state[3] += len(piece)
                        state[4].update(piece.encode())
                state[5] += len(text)
                state[6] += len(loss)
                state[7] += int(loss.sum())
            if len(done) > 1000:
                yield out(done)
                done = []
        if state:
            done.append(close(state))
        if done:
            yield out(done)

    return sections.mapInArrow(run, READ_BACK)
