"""Language-model scores from a probabilistic suffix tree over words (operator 3).

The tree's nodes are contexts of preceding words. Lengths of one to four words are looked
at one by one, longer ones in steps of a half or a third (6, 8, 12, 16, ...), as far as the
texts repeat; nothing but the texts, or a ``depth`` that is asked for, ends this. A context
is kept if it is seen often enough, in fewer places than its suffix of the length before
(else both are one node of the tree), and its next-word distribution diverges from that of
its longest kept suffix: the training occurrences after it, each predicted with itself left
out, must gain a given log likelihood over the suffix's prediction, so chance repeats do
not pass. A kept context's distribution is smoothed towards its suffix's with a fixed prior
weight; the root is the add-one unigram distribution with one class for unknown words.
Every token is scored in the longest kept suffix of the words before it.

Neither the tree nor any count is gathered in one place. Documents are turned into
blocks of word numbers of bounded size, written once. A block asks for just the sums
that its own tokens need: it sends its distinct n-grams, pre-aggregated, to parts of the
key space, which add up all blocks' counts and answer in the same order. However common a
word or pair is, it is one entry per block.

Words, pairs and the contexts of one and two words concern every token and are exchanged
first. From there only living positions are carried on from step to step: those behind a
context that is frequent and whose extensions could still gain enough. What a context's
extensions can gain is bounded by what its own occurrences could if each word's were
predicted as well as a context that holds only them would; a word seen once can gain
nothing. Below the asked gain no longer context can pass, and its positions are done. The
work of a step is that of its living positions, and long copies take few steps.

Only what does not follow from earlier answers is asked. Where every word, or none, behind a
context is a position's own, so it is behind each extension of it. A context in the same
places as its suffix, which was not kept, has that suffix's bound. The blocks are written anew
without their finished documents when few of their tokens are left; they and the living
positions are bucketed by block, so that only requests and answers are shuffled.

Words are ``[^\\x20\\x09-\\x0D]+`` with ``A-Z`` lowered and stand as 64-bit hashes; a text
ends with one end token, so a null or empty text is that token alone. Contexts do not
reach over a document's start. Training documents are those for which ``held_out`` is
not true. Rows with equal ids are separate documents. With no training tokens every
token is unknown. An empty table gives no rows.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semsift.llm.common import give_back, parallelism, passing_shuffles, release, stage
from semsift.llm.wordhash import mix64, slices, word_hashes
from semsift.session import scratch_path

#: Context lengths that are exchanged for all tokens.
DENSE = 2
#: Occurrences from which a context is looked at, and those it must have to be extended:
#: every context that is tested needs the counts of its next words.
MIN_CONTEXT, MIN_EXTEND = 3, 3
#: Pseudo-count of the suffix's distribution, and the log10 gain a kept context shows.
PRIOR, MIN_GAIN = 2.0, 1.0
#: A bound that reaches the asked gain, as it is sent.
FULL = 255
BLOCK_BYTES = 6 << 20
#: Tokens, or living positions, for which the key space has one more part.
PART_TOKENS = 200_000
#: Blocks are written anew when so small a part of their tokens is in living documents.
LEFT_SHARE = 1 / 3
#: Living tokens for which blocks written anew have one more bucket.
BUCKET_TOKENS = 400_000
#: Windows are hashed word by word where that takes so many words a token at most.
WORDS_AT_ONCE = 4
#: Bytes of a group after which a worker returns the memory it has freed.
TRIM_BYTES = 1 << 20
END = np.uint64(0x5EED0FE9D0C5E9D1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "block long, words binary, numbers binary, tokens binary, ids array<long>, held array<boolean>, n long"
REQUEST = "block long, part int, kind int, size long, keys binary, amounts binary, bounds binary"
ANSWER = "block long, part int, kind int, size long, sums binary, total double, found long"
#: One row a block: its documents' scores by the dense contexts, and its living positions.
STATE = "size long, pos binary, p binary, n binary, c binary, ahead binary, mark binary, reach long"
#: Bits of a living position's mark: it is in a kept context; its context's extensions may be
#: kept, as is known without asking.
INSIDE, SURE = 1, 2
#: What a block puts out in a step: requests, its living positions, what kept contexts
#: change in its documents' scores, and at the end of the dense steps these scores.
STEPS = ("block long, part int, kind int, keys binary, amounts binary, bounds binary, " + STATE
         + ", docs binary, change binary, entered binary, ids array<long>, held array<boolean>, tokens binary, "
         "known binary, base binary, score binary, inside_n binary")
GAIN, NEXT_N, NEXT_C, LIVING, CHANGE, SCORED = 0, 1, 2, -1, -2, -3
SPARSE_ANSWER = "block long, part int, kind int, size long, sums binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double, n_in_context long")


def _pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed, as many as the largest whole number needs."""
    if not len(values):
        return b""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    width = raw.shape[1] if values.dtype.kind == "f" else max(1, -(-int(values.max()).bit_length() // 8))
    planes = np.empty((width, len(values)), np.uint8)
    for k in range(width):
        planes[k] = raw[:, k]
    return bytes([width]) + pa.compress(pa.py_buffer(planes), "zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    if n:
        width = data[0]
        planes = np.frombuffer(pa.decompress(memoryview(data)[1:], width * n, "zstd"), np.uint8).reshape(width, n)
        for k in range(width):
            out[:, k] = planes[k]
    return out.view(kind).reshape(n)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and each key's place among them. Places ride in the low bits of
    the leading key bits through one plain sort; keys that only differ below are put right."""
    n = len(keys)
    if n < 2:
        return keys.copy(), np.zeros(n, np.int64)
    low = keys.min()
    spare = 64 - int(keys.max() - low).bit_length()
    places = np.uint64((1 << (n - 1).bit_length()) - 1)
    order = np.sort(((keys - low) << np.uint64(min(spare, 63)) & ~places) | np.arange(n, dtype=np.uint64))
    order = (order & places).view(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = order[np.argsort(ranked, kind="stable")]
        ranked = keys[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    where = np.empty(n, np.int64)
    where[order] = np.cumsum(fresh) - 1
    return ranked[fresh], where


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo, hi in slices(batch.column(2), BLOCK_BYTES):
            words, at = word_hashes(batch.column(2).slice(lo, hi - lo))
            words = np.insert(words, at[1:], END)
            distinct, numbers = _distinct(words)
            yield pa.record_batch([
                pa.array([number]), pa.array([distinct.tobytes()], pa.binary()),
                pa.array([_pack(numbers.astype("<u4"))], pa.binary()),
                pa.array([(np.diff(at) + 1).astype("<i8").tobytes()], pa.binary()),
                pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                pa.array([batch.column(1).slice(lo, hi - lo).to_pylist()], pa.list_(pa.bool_())), pa.array([len(words)])],
                names=[c.split()[0] for c in BLOCKS.split(", ")])
            number += 1
    give_back()


def _count_kind(order: int) -> int:
    return 2 * order


def _gain_kind(length: int) -> int:
    return 2 * length + 1


class _Block:
    """A block's tokens with what is known of their n-grams so far."""

    def __init__(self, blocks: pa.Table, answers: pa.Table, total: float, distinct: float):
        row = blocks.to_pylist()[0]
        self.number, self.ids = row["block"], row["ids"]
        self.size = total + distinct + 1
        self.tokens = np.frombuffer(row["tokens"], "<i8")
        n = int(self.tokens.sum())
        self.vocabulary = np.frombuffer(row["words"], "<u8")     # sorted, so its places are keys' places
        self.numbers = _unpack(row["numbers"], n, "<u4").astype(np.int64)
        self.words = self.vocabulary[self.numbers]
        self.held = np.array([bool(h) for h in row["held"]])
        self.doc = np.repeat(np.arange(len(self.tokens)), self.tokens)
        self.train = ~self.held[self.doc]
        self.place = np.arange(n) - np.repeat(np.cumsum(self.tokens) - self.tokens, self.tokens)
        self.sums: dict[int, list] = {}
        for r in sorted(answers.to_pylist(), key=lambda r: r["part"]):
            self.sums.setdefault(r["kind"], []).append(_unpack(r["sums"], r["size"], "<u8").astype(np.float64))
        self.order, self.keys = 1, self.words
        self.distinct: dict[int, tuple] = {}
        self.count: dict[int, np.ndarray] = {}
        self.lively: dict[int, tuple] = {}
        self.length, self.p = -1, np.ones(0)

    def gram(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose n-gram of this order is counted, its distinct keys, and the
        positions' places among these."""
        if order == 1:
            return np.arange(len(self.words)), self.vocabulary, self.numbers
        if order not in self.distinct:
            at = self.place >= order - 1
            if order > 2:
                # for the word after a context, and as a context of the next word
                alive, settled = self.alive(order - 2)
                often = self.behind(order - 1) >= MIN_EXTEND
                after = np.append(alive[1:], False) & (self.counts(order - 1) >= MIN_EXTEND)
                at &= (alive & often) | (settled & after)
            at = np.flatnonzero(at)
            while self.order < order:
                self.keys = mix64(np.append(np.uint64(0), self.keys[:-1]) * _STEP + self.words)
                self.order += 1
            self.distinct[order] = (at, *_distinct(self.keys[at]))
        return self.distinct[order]

    def alive(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the context of this length before each position is frequent and could have
        a kept extension, and whether it or a suffix is settled: always followed by the
        same word. If that gains enough over the suffix the context is kept, and an extension
        could gain n * log10((n + PRIOR) / n) more, under MIN_GAIN whatever n; else the
        extension, with no more occurrences, gains too little as well."""
        if length == 0:
            return np.ones(len(self.words), bool), np.zeros(len(self.words), bool)
        if length not in self.lively:
            alive, settled = self.alive(length - 1)
            n = self.behind(length)
            alive = alive & (n >= MIN_EXTEND)
            done = alive & (self.counts(length + 1) == n)
            self.lively[length] = (alive & ~done, settled | done)
        return self.lively[length]

    def counts(self, order: int) -> np.ndarray:
        """Training count of each position's n-gram (0 where it is not counted)."""
        if order not in self.count:
            at, _, where = self.gram(order)
            out = np.zeros(len(self.words))
            if len(at):
                out[at] = np.concatenate(self.sums[_count_kind(order)])[where]
            self.count[order] = out
            self.count.pop(order - 3, None)
        return self.count[order]

    def behind(self, length: int) -> np.ndarray:
        """Training count of the context of this length before each position."""
        out = np.append(0.0, self.counts(length)[:-1])
        out[self.place < length] = 0
        return out

    def contexts(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions behind a context of this length that is to be looked at, the distinct
        contexts' keys, and the positions' places among these. A context is the n-gram that
        ends one position before, so its place among those is known."""
        at = np.flatnonzero((self.behind(length) >= MIN_CONTEXT) & self.alive(length - 1)[0])
        grams, keys, where = self.gram(length)
        if length > 1:
            place = np.zeros(len(self.words), np.int64)
            place[grams] = where
        else:
            place = where
        of = place[at - 1]
        present = np.zeros(len(keys), bool)
        present[of] = True
        return at, keys[present], (np.cumsum(present) - 1)[of]

    def predict(self, length: int) -> np.ndarray:
        """Each token's probability in the longest kept context of up to this length (lengths
        are asked for in ascending order)."""
        if self.length < 0:
            self.length, self.p = 0, (self.counts(1) + 1) / self.size
            self.in_context = np.zeros(len(self.p), bool)
        while self.length < length:
            k = self.length + 1
            at, _, where = self.contexts(k)
            self.length = k
            self.going, self.moved = np.zeros(len(self.p), bool), np.zeros(len(self.p), bool)
            if len(at):
                flag = np.concatenate(self.sums[_gain_kind(k)]).astype(np.int64)[where]
                self.going[at] = flag >= 2
                kept = at[flag % 2 == 1]
                n = self.behind(k)[kept]
                self.p = self.p.copy()
                self.p[kept] = (self.counts(k + 1)[kept] + PRIOR * self.p[kept]) / (n + PRIOR)
                self.in_context[kept] = self.moved[kept] = True
        return self.p

    def requests(self, step: int, last: bool, parts: int) -> list[dict]:
        """What the step asks for; the last one needs no longer n-grams."""
        out = []
        if step == 0:
            for order in (1, 2):
                at, keys, where = self.gram(order)
                out += self._ask(_count_kind(order), keys, np.bincount(
                    where, weights=self.train[at], minlength=len(keys)), None, parts)
            return out
        at, keys, where = self.contexts(step)
        parent = self.predict(step - 1)
        if not last:
            grams, longer, of = self.gram(step + 2)
            out += self._ask(_count_kind(step + 2), longer, np.bincount(
                of, weights=self.train[grams], minlength=len(longer)), None, parts)
        if len(at):
            parent = parent[at]
            n, c = self.behind(step)[at], self.counts(step + 1)[at]
            left_out = (np.maximum(c - 1, 0) + PRIOR * parent) / (n - 1 + PRIOR)
            proper = n < self.behind(step - 1)[at] if step > 1 else True
            gain = np.where(self.train[at] & proper, np.log10(left_out / parent), 0.0)
            add = lambda x: np.bincount(where, weights=x, minlength=len(keys))
            out += self._ask(_gain_kind(step), keys, *_gains(add(gain), add(_most(self.train[at], c, parent))), parts)
        return out

    def _ask(self, kind: int, keys: np.ndarray, amounts: np.ndarray, bounds, parts: int) -> list[dict]:
        return _split(self.number, kind, keys, amounts, bounds, parts)

    def ended(self, length: int, go_on: bool, row: dict, parts: int) -> list[dict]:
        """The documents' scores by contexts of up to ``length``; if longer ones follow, the
        living positions with the counts of this length, and requests for the next."""
        per = lambda x: np.bincount(self.doc, weights=x, minlength=len(self.tokens))
        known, base = per(self.counts(1) > 0), per(np.log10(self.predict(0)))
        p = self.predict(length)
        out = [{"block": self.number, "part": 0, "kind": SCORED, "ids": self.ids, "held": self.held.tolist(),
                "tokens": self.tokens.tobytes(), "known": known.astype("<i8").tobytes(), "base": base.tobytes(),
                "score": per(np.log10(p)).tobytes(), "inside_n": per(self.in_context).astype("<i8").tobytes()}]
        if go_on:
            at = np.flatnonzero(self.alive(length)[0] & self.going & (self.behind(length + 1) >= MIN_CONTEXT))
            if len(at):
                n, c = self.behind(length)[at], self.counts(length + 1)[at]
                left = _Windows(row, at, next_length(length))
                mark = INSIDE * self.in_context[at] + SURE * ~self.moved[at]
                out.append({"block": self.number, "part": 0, "kind": LIVING,
                            **_state(at, p[at], n, c, mark, left.reach(slice(None)), self.behind(length + 1)[at])})
                out += left.ask_counts(self.number, np.ones(len(at), bool), n, c, next_length(length), parts)[NEXT_C]
        return out


def _state(pos, p, n, c, mark, reach: int, ahead=()) -> dict:
    """``ahead``: counts of the next contexts, where they are known already."""
    return {"size": len(pos), "pos": _pack(np.diff(pos, prepend=0).astype("<u4")), "p": _pack(p.astype("<f8")),
            "n": _pack(n.astype("<u8")), "c": _pack(c.astype("<u8")),
            "ahead": _pack(np.asarray(ahead).astype("<u8")), "mark": _pack(mark.astype("u1")), "reach": reach}


def _split(block: int, kind: int, keys: np.ndarray, amounts: np.ndarray, bounds, parts: int) -> list[dict]:
    """Requests: sorted keys fall into parts by their leading bits, a run of them for each part."""
    edge = np.searchsorted(keys >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
                           // np.uint64(parts), "left")
    return [{"block": block, "part": p, "kind": kind, "size": b - a,
             "keys": _pack(np.diff(keys[a:b], prepend=np.uint64(0))),      # the gaps of sorted keys are shorter
             "amounts": _pack(amounts[a:b].astype("<u8" if bounds is None else "<f4")),
             "bounds": None if bounds is None else _pack(bounds[a:b])}
            for p, (a, b) in enumerate(zip(edge, edge[1:])) if a < b]


def _gains(gain: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As they are sent. A bound is rounded up to a part of the asked gain in steps of one in
    ``FULL``, and no more than that is sent: bounds are not negative, so a sum that reaches
    the asked gain still does."""
    return gain.astype(np.float32), np.ceil(np.minimum(most / MIN_GAIN, 1.0) * FULL).astype(np.uint8)


def _most(train: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What each position could gain behind an extension of its context that holds only the
    occurrences before its own word."""
    most = (np.maximum(c - 1, 0) + PRIOR * p) / (c + PRIOR - 1)
    return np.where(train & (c > 1), np.maximum(np.log10(most / p), 0.0), 0.0)


def next_length(length: int) -> int:
    """1, 2, 3, 4, 6, 8, 12, 16, ..."""
    if length < 4:
        return length + 1
    return length * 3 // 2 if length & (length - 1) == 0 else length * 4 // 3


class _Windows:
    """Living positions of a block: their places, words and the hashes of the windows before
    them, of any length at once. Only documents with such positions are worked out."""

    def __init__(self, row: dict, pos: np.ndarray, longest: int):
        """``longest``: no longer windows are asked for."""
        tokens = np.frombuffer(row["tokens"], "<i8")
        numbers = _unpack(row["numbers"], int(tokens.sum()), "<u4")
        vocabulary = np.frombuffer(row["words"], "<u8")
        begin, self.tokens = np.cumsum(tokens) - tokens, tokens
        self.doc = np.searchsorted(begin, pos, "right") - 1      # every document has a token
        self.place = pos - begin[self.doc]
        self.word = vocabulary[numbers[pos]]
        self.train = ~np.array([bool(h) for h in row["held"]])[self.doc]
        fresh = np.diff(self.doc, prepend=-1) > 0
        docs = self.doc[fresh]
        size = pos[np.append(fresh[1:], True)] - begin[docs] + 1     # up to the last living position
        n = int(size.sum())
        self.total = None
        if longest * len(pos) <= WORDS_AT_ONCE * n:      # few words: each position's own
            self.at, self.numbers, self.mixed = pos, numbers, mix64(vocabulary)
            self.length, self.sums = 0, np.zeros(len(pos), np.uint64)
            return
        first = np.cumsum(size) - size
        numbers = numbers[np.arange(n) + np.repeat(begin[docs] - first, size)]
        self.at = self.place + first[np.cumsum(fresh) - 1]
        power = np.full(n + 1, _STEP, np.uint64)
        power[0] = 1
        inverse = np.full(n + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))
        inverse[0] = 1
        power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        self.total = np.concatenate([np.zeros(1, np.uint64),
                                     np.cumsum(mix64(vocabulary)[numbers] * power[:n], dtype=np.uint64)])

    def keys(self, chosen: np.ndarray, length: int) -> np.ndarray:
        """Lengths are asked for in ascending order; the chosen positions have so many words before them."""
        if self.total is None:
            while self.length < length:
                self.length += 1
                self.sums = self.sums * _STEP + self.mixed[self.numbers[np.maximum(self.at - self.length, 0)]]
            return mix64(self.sums[chosen] + np.uint64(length))
        at = self.at[chosen]
        return mix64((self.total[at] - self.total[at - length]) * self.inverse[at - length] + np.uint64(length))

    def reach(self, chosen) -> int:
        """Tokens of the documents that these positions are in."""
        return int(self.tokens[np.unique(self.doc[chosen])].sum())

    def next_keys(self, chosen: np.ndarray, n: np.ndarray, c: np.ndarray, length: int) -> tuple:
        """Distinct contexts and each position's place in them; the positions whose counts of
        context and word ``n`` and ``c``, those of the length before, leave the next open; and
        distinct contexts with words, with these positions' places in them."""
        windows = self.keys(chosen, length)
        unsure = np.flatnonzero((c[chosen] > 0) & (c[chosen] < n[chosen]))
        grams = mix64(windows[unsure] * _STEP + self.word[chosen[unsure]])
        return _distinct(windows), unsure, _distinct(grams)

    def ask_counts(self, number: int, chosen: np.ndarray, n: np.ndarray, c: np.ndarray, length: int,
                   parts: int) -> dict[int, list[dict]]:
        """Requests, by kind, for the counts of the contexts of a length, where they fit in the
        document."""
        chosen = np.flatnonzero(chosen & (self.place >= length))
        (windows, n_at), unsure, (grams, c_at) = self.next_keys(chosen, n, c, length)
        train = self.train[chosen]
        return {kind: _split(number, kind, keys, np.bincount(at, amount, len(keys)), None, parts)
                for kind, keys, at, amount in ((NEXT_N, windows, n_at, train), (NEXT_C, grams, c_at, train[unsure]))}


def _advance(before: int, length: int, parts: int):
    """Takes the answers for contexts of ``before`` words, drops what is done, and asks for
    the gains of those of ``length`` and the counts of the next ones."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], STEPS)
        state, rows = left.to_pylist()[0], right.to_pylist()
        out: list[dict] = []
        number = key[0].as_py()
        read = lambda name, kind: _unpack(state[name], state["size"], kind)
        pos, p = np.cumsum(read("pos", "<u4").astype(np.int64)), read("p", "<f8")
        n, c = (read(k, "<u8").astype(np.float64) for k in ("n", "c"))
        mark = read("mark", "u1")
        inside, sure = mark & INSIDE > 0, mark & SURE > 0
        block = _Windows(state, pos, next_length(length))
        sums = {k: np.concatenate([np.zeros(0)] + [_unpack(r["sums"], r["size"], "<u8") for r in
                                                   sorted((r for r in rows if r["kind"] == k), key=lambda r: r["part"])])
                for k in (GAIN, NEXT_N, NEXT_C)}
        flag = np.full(len(pos), 2)              # of the dense contexts, gains are known
        if before > DENSE and not sure.all():
            flag[~sure] = sums[GAIN].astype(np.int64)[_distinct(block.keys(~sure, before))[1]]
        kept = flag % 2 == 1
        moved = kept if before > DENSE else ~sure
        if kept.any():
            fresh = (c[kept] + PRIOR * p[kept]) / (n[kept] + PRIOR)
            doc, at = np.unique(block.doc[kept], return_inverse=True)
            out.append({"block": number, "part": 0, "kind": CHANGE, "size": len(doc), "docs": doc.astype("<u4").tobytes(),
                        "change": np.bincount(at, np.log10(fresh) - np.log10(p[kept])).astype("<f8").tobytes(),
                        "entered": np.bincount(at, ~inside[kept]).astype("<i8").tobytes()})
            p, inside = p.copy(), inside | kept
            p[kept] = fresh
        far = np.flatnonzero(block.place >= length)
        n_next, c_next, window = np.zeros(len(pos)), np.zeros(len(pos)), np.zeros(len(pos), np.int64)
        (windows, n_at), unsure, (_, c_at) = block.next_keys(far, n, c, length)
        window[far] = n_at
        n_next[far] = sums[NEXT_N][n_at] if before > DENSE else read("ahead", "<u8")[far]
        c_next[far] = np.where(c[far] == n[far], n_next[far], 0.0)
        c_next[far[unsure]] = sums[NEXT_C][c_at]
        # always followed by one word: what the context and any extension could gain is known here,
        # and in each block that has it
        hopeless = (c_next == n_next) & ~moved & (n_next * _most(True, c_next, p) < MIN_GAIN)
        go = (flag >= 2) & (n_next >= MIN_CONTEXT) & ~hopeless
        if not go.any():
            return _table(out, STEPS)
        at = np.flatnonzero(go)
        same = (~moved & (n_next == n))[at]      # the suffix's places, words and bound
        asked = at[~same]
        train = block.train[asked]
        left_out = (np.maximum(c_next[asked] - 1, 0) + PRIOR * p[asked]) / (n_next[asked] - 1 + PRIOR)
        gain = np.where(train & (n_next < n)[asked], np.log10(left_out / p[asked]), 0.0)
        present = np.zeros(len(windows), bool)
        present[window[asked]] = True
        keys, where = windows[present], (np.cumsum(present) - 1)[window[asked]]
        add = lambda x: np.bincount(where, x, len(keys))
        out += _split(number, GAIN, keys, *_gains(add(gain), add(_most(train, c_next[asked], p[asked]))), parts)
        for rows in block.ask_counts(number, go, n_next, c_next, next_length(length), parts).values():
            out += rows
        out.append({"block": number, "part": 0, "kind": LIVING, **_state(
            pos[at], p[at], n_next[at], c_next[at], INSIDE * inside[at] + SURE * same, block.reach(at))})
        _trim(left)
        return _table(out, STEPS)

    return run


def _compact(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The block without the words of documents that have no living position."""
    row = table.to_pylist()[0]
    tokens = np.frombuffer(row["tokens"], "<i8")
    pos = np.cumsum(_unpack(row["pos"], row["size"], "<u4").astype(np.int64))
    living = np.zeros(len(tokens), bool)
    living[np.searchsorted(np.cumsum(tokens), pos, "right")] = True
    living = np.repeat(living, tokens)
    numbers = _unpack(row["numbers"], len(living), "<u4").copy()
    used, numbers[living] = np.unique(numbers[living], return_inverse=True)
    numbers[~living] = 0
    words = np.frombuffer(row["words"], "<u8")[used]
    return _table([row | {"words": words.tobytes(), "numbers": _pack(numbers), "n": row["reach"]}], BLOCKS)


def _add_up_living(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums by key over all blocks; of a context, whether it is kept (1) and whether its
    extensions may be (2)."""
    rows = table.to_pylist()
    answers, _ = _totals(rows)
    _trim(table)
    return _table([{"block": r["block"], "part": r["part"], "kind": r["kind"], "size": len(a), "sums": _pack(a)}
                   for r, a in zip(rows, answers)], SPARSE_ANSWER)


def _final(total: float):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SCORE_SCHEMA.empty_table()
        row = left.to_pylist()[0]
        read = lambda name, kind: np.frombuffer(row[name], kind).copy()
        score, inside = read("score", "<f8"), read("inside_n", "<i8")
        for change in right.to_pylist():
            docs = np.frombuffer(change["docs"], "<u4")
            score[docs] += np.frombuffer(change["change"], "<f8")
            inside[docs] += np.frombuffer(change["entered"], "<i8")
        n = len(score)
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()), "held_out": pa.array([bool(h) for h in row["held"]]),
            "n_tokens": pa.array(read("tokens", "<i8")), "n_known": pa.array(read("known", "<i8")),
            "train_tokens": pa.array(np.full(n, int(total))), "base_score": pa.array(read("base", "<f8")),
            "score": pa.array(score), "n_in_context": pa.array(inside)})

    return run


def _table(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
             "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array([r.get(n) for r in rows], kinds[t]) for n, t in fields})


def _rows(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array([r[n] for r in rows], kinds[t]) for n, t in fields})


def _totals(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums by key over all blocks' requests to a part: in each block's order, and once. Of
    a gain, blocks need to know only whether the context is kept (1) and whether its
    extensions may be (2)."""
    keys = [np.cumsum(_unpack(r["keys"], r["size"], "<u8"), dtype=np.uint64) for r in rows]
    distinct, where = _distinct(np.concatenate(keys))
    add = lambda name, kind: np.bincount(where, weights=np.concatenate(
        [_unpack(r[name], len(k), kind) for r, k in zip(rows, keys)]), minlength=len(distinct))
    if rows[0]["bounds"] is None:
        total = add("amounts", "<u8")
    else:
        total = (add("amounts", "<f4") >= MIN_GAIN) + 2 * (add("bounds", "u1") >= FULL)
    total = total.astype("<u8")
    return np.split(total[where], np.cumsum([len(k) for k in keys])[:-1]), total


def _add_up(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    answers, total = _totals(rows)
    _trim(table)
    out = [{"block": r["block"], "part": r["part"], "kind": r["kind"], "size": len(a), "sums": _pack(a),
            "total": None, "found": None} for r, a in zip(rows, answers)]
    out[0] |= {"total": float(total.sum()), "found": int((total > 0).sum())}      # of the part
    return _rows(out, ANSWER)


def _trim(table: pa.Table) -> None:
    """Returns what a large group has freed."""
    if table.nbytes >= TRIM_BYTES:
        give_back(collect=False)


def _requests(step: int, last: bool, parts: int, total: float, distinct: float):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _Block(left, right, total, distinct).requests(step, last, parts) if left.num_rows else []
        _trim(left)
        return _rows(rows, REQUEST)

    return run


def _ended(length: int, go_on: bool, total: float, distinct: float, parts: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _Block(left, right, total, distinct).ended(length, go_on, left.to_pylist()[0], parts) if left.num_rows else []
        _trim(left)
        return _table(rows, STEPS)

    return run


def suffix_tree_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
                       depth: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, n_in_context`` (scores are log10 probabilities of the text).
    Contexts are as long as the texts and the divergence test make them, or of ``depth``
    words at most."""
    with passing_shuffles(docs.sparkSession):
        return _scores(docs, held_out, id_col, text_col, depth)


def _scores(docs: DataFrame, held_out: Column, id_col: str, text_col: str, depth: int | None) -> DataFrame:
    spark = docs.sparkSession
    parts = parallelism(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(held_out, F.lit(False)).alias("held"), F.col(f"`{text_col}`").alias("text"))
    buckets = parts
    blocks = _bucketed(rows.mapInArrow(_blocks, BLOCKS), "lm-blocks", buckets)
    written = blocks.agg(F.sum("n")).first()[0] or 0
    parts = _parts(written, parts)
    dense = DENSE if depth is None else min(depth, DENSE)
    go_on = depth is None or depth > DENSE
    answers, held = spark.createDataFrame([], ANSWER), []
    total = distinct = 0.0
    for step in range(dense + 1):
        requests = blocks.groupBy("block").cogroup(answers.drop("total", "found").groupBy("block")).applyInArrow(
            _requests(step, step == dense, parts, total, distinct), REQUEST)
        found = stage(requests.repartition(parts, "part", "kind").groupBy("part", "kind")
                      .applyInArrow(_add_up, ANSWER), "lm-sums")
        held.append(found)
        answers = found if step == 0 else answers.unionByName(found)
        if step == 0:
            # training tokens and distinct training words
            total, distinct = map(float, found.where(F.col("kind") == _count_kind(1)).agg(
                F.coalesce(F.sum("total"), F.lit(0.0)), F.coalesce(F.sum("found"), F.lit(0))).first())
    ended = _bucketed(blocks.groupBy("block").cogroup(answers.drop("total", "found").groupBy("block")).applyInArrow(
        _ended(dense, go_on, total, distinct, parts), STEPS), "lm-dense", buckets, "kind")
    release(*held)

    changes = spark.createDataFrame([], "block long, docs binary, change binary, entered binary")
    step, before, length = ended, DENSE, next_length(DENSE)
    while True:
        state = spark.table(step._table).where(F.col("kind") == LIVING).select("block", *_names(STATE))
        left, reach = state.agg(F.sum("size"), F.sum("reach")).first()
        if not left or (depth is not None and before > depth):
            break
        found = stage(step.where(F.col("kind") >= 0).repartition(parts, "part", "kind").groupBy("part", "kind")
                      .applyInArrow(_add_up_living, SPARSE_ANSWER), "lm-sums")
        parts = _parts(left, parts)      # of what is asked next: no more than these live
        _drop(step, GAIN, NEXT_N, NEXT_C)
        if reach <= LEFT_SHARE * written:
            whole, written = blocks, reach
            buckets = max(1, min(buckets, -(-reach // BUCKET_TOKENS)))
            blocks = _bucketed(_with_state(whole, state).groupBy("block").applyInArrow(_compact, BLOCKS), "lm-blocks", buckets)
            _forget(whole)
            release(whole)
        last, step = step, _bucketed(_with_state(blocks, state).groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
            _advance(before, length, parts), STEPS), "lm-living", buckets, "kind")
        release(found)
        _drop(last, LIVING)
        _forget(last)
        changes = changes.union(step.where(F.col("kind") == CHANGE).select("block", "docs", "change", "entered"))
        before, length = length, next_length(length)
    scored = ended.where(F.col("kind") == SCORED)
    result = scored.groupBy("block").cogroup(changes.groupBy("block")).applyInArrow(_final(total), SCORES)
    _forget(step)
    _forget(blocks)
    release(blocks)
    return result


def _with_state(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Blocks that have living positions, with these; both are bucketed, so nothing is shuffled."""
    return blocks.drop("n").join(state.hint("merge"), "block")


def _bucketed(df: DataFrame, name: str, buckets: int, *partition_by: str) -> DataFrame:
    """Like ``stage``, bucketed by block: read through its catalog name, the table is not shuffled again."""
    spark, path, table = df.sparkSession, scratch_path(df.sparkSession, name), f"lm_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, "block").option("path", path)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(table)
    out = spark.read.schema(df.schema).parquet(path) if partition_by else spark.table(table)
    out._staged_path, out._table = path, table
    return out


def _forget(table: DataFrame) -> None:
    """Takes a bucketed table's name out of the catalog; its files stay."""
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._table}")


def _parts(size: int | None, most: int) -> int:
    """Parts of the key space for so many tokens or positions. Each block sends a request to each
    part, so their number must not exceed what the sums are worth."""
    return max(1, min(most, -(-(size or 0) // PART_TOKENS)))


def _drop(step: DataFrame, *kinds: int) -> None:
    """Deletes rows of a staged step that nothing reads any more; its changes stay."""
    sc = step.sparkSession.sparkContext
    for kind in kinds:
        folder = sc._jvm.org.apache.hadoop.fs.Path(f"{step._staged_path}/kind={kind}")
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                          ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()),
                          ("score", pa.float64()), ("n_in_context", pa.int64())])
