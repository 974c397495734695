"""Prefix trie of conversations, screened by a count-min sketch (operator 13).

A node of the trie is a distinct sequence of a conversation's first turns. Most prefixes
belong to one conversation only, and need no grouping:

1. The turns of a conversation stream in order through one task, which chains a digest
   per prefix. Staged are 24 bytes a turn, in sections of bounded size; texts stay behind.
2. A count-min sketch with two rows counts the prefix digests; cells stop at two. A
   prefix whose estimate is one occurs once, as a cell never counts less than its prefixes.
3. Nodes of such prefixes are put out where they are, without a shuffle. Only prefixes
   with an estimate of two or more are shuffled and grouped exactly, so a collision in the
   sketch costs a shuffled row and never changes a result.

The sketch has four cells a prefix, up to ``MAX_CELLS`` a row: its bits are broadcast and
take ``2 * MAX_CELLS / 8`` bytes at most. Beyond that it lets more prefixes through.

Sums over subtrees need no walk through the tree. A leaf belongs to the smallest member of
its node, and that member lies in every node above, so leaves are summed over members. In
``(n_convs - 1) * bytes`` every member but the smallest pays the bytes of a node; a
conversation that is the smallest member of a node is so of all deeper nodes on its path,
so what it pays below a node is a difference of two running totals.

Null roles and texts count as empty; turns are ordered by ``turn`` (nulls first), then role
and text, so ties and repeated rows have a fixed order and all count. Rows without a
conversation id belong to no conversation. An empty table gives no rows, not even a root.
Conversation ids are numbers; the base of a negative id rounds down.
"""
from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semsift.llm.common import parallelism, pick, stage, text_or_empty

KEY = 16
#: Turns of a staged section.
SECTION = 8192
#: Cells of one row of the sketch.
MAX_CELLS = 1 << 27
MIN_CELLS = 1 << 16
_BLOCK_BITS = 16
#: Conversation ids of one chunk of a node's digest.
CHUNK_IDS = 50_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

SECTIONS = ("conv_id long, first long, n int, prev binary, keys binary, cum binary, before long, rest int")
SHARED = ("k0 long, k1 long, conv_id long, depth long, before long, cum long, has_next boolean, "
          "next_alone boolean, next_last boolean")
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=_columns(schema))


class _Path:
    """The prefix digests of one conversation, given out in sections."""

    def __init__(self, conv: int, section: int):
        self.conv, self.section = conv, section
        self.first, self.prev, self.chain, self.before, self.total = 1, b"", b"", 0, 0
        self.keys, self.cum = bytearray(), array("q")

    def add(self, turn: bytes, size: int) -> Iterator[tuple]:
        self.chain = hashlib.blake2b(self.chain + turn, digest_size=KEY).digest()
        self.total += size
        self.keys += self.chain
        self.cum.append(self.total)
        if len(self.cum) == self.section + 2:     # what comes after a section is known
            yield self._take(self.section)

    def end(self) -> Iterator[tuple]:
        while len(self.cum) > self.section:
            yield self._take(self.section)
        if self.cum or self.first == 1:
            yield self._take(len(self.cum))

    def _take(self, n: int) -> tuple:
        rest = min(2, len(self.cum) - n)
        row = (self.conv, self.first, n, self.prev, bytes(self.keys[:KEY * (n + min(rest, 1))]),
               self.cum[:n].tobytes(), self.before, rest)
        if n:
            self.prev, self.before = bytes(self.keys[KEY * (n - 1):KEY * n]), self.cum[n - 1]
        self.keys, self.cum, self.first = self.keys[KEY * n:], self.cum[n:], self.first + n
        return row


def conversation_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                       text_col: str = "text", family: int = 1, openings: int = 1,
                       section: int = SECTION) -> DataFrame:
    """Sections of prefix digests, one shuffle of the turns.

    With ``family`` and ``openings`` above 1, conversation ``c`` opens with the first ``h``
    turns of conversation ``c - c % family`` instead of its own first ``h``, where ``h`` is
    ``crc32(c) % openings``. A family's ids follow each other in one task's order, the one
    that lends its opening first; the task keeps digests of ``openings - 1`` turns."""

    def digest(role: bytes, text: bytes) -> bytes:
        return hashlib.blake2b(len(role).to_bytes(8, "big") + role + text, digest_size=KEY).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, opening, path, at, h, out, size = None, [], None, 0, 0, [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                done = []
                if path is None or conv != path.conv:
                    if path is not None:
                        done += path.end()
                    if base != conv - conv % family:
                        base, opening = conv - conv % family, []
                    path, at = _Path(conv, section), 0
                    h = zlib.crc32(str(conv).encode()) % openings if conv != base else 0
                    for turn in opening[:h]:
                        done += path.add(*turn)
                turn = digest(role, text), len(text)
                at += 1
                if conv == base and at < openings:
                    opening.append(turn)
                if at > h:
                    done += path.add(*turn)
                out += done
                size += sum(len(r[4]) for r in done) + 64 * len(done)
                if size > 1 << 20:
                    yield _batch(out, SECTIONS)
                    out, size = [], 0
        if path is not None:
            out += path.end()
        yield _batch(out, SECTIONS)

    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", text_or_empty("role").alias("role"),
        text_or_empty("text").alias("text")).where("conv_id is not null")
    key = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(family))
    ordered = (rows.repartition(parallelism(turns.sparkSession), key)
               .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
               .select("conv_id", F.col("role").cast("binary"), F.col("text").cast("binary")))
    return ordered.mapInArrow(run, SECTIONS)


# ---------------------------------------------------------------------------
# the sketch
# ---------------------------------------------------------------------------

def _cells(keys: bytes, cells: int) -> np.ndarray:
    """Cells of both rows of the sketch, ``(prefixes, 2)``; the second row lies behind the first."""
    pairs = np.frombuffer(keys, dtype="<u8").reshape(-1, 2)
    return (pairs & np.uint64(cells - 1)).astype(np.int64) + np.array([0, cells])


def prefix_sketch(paths: DataFrame, cells: int) -> np.ndarray:
    """For every cell, whether two or more prefixes fall into it, as packed bits."""
    size = min(1 << _BLOCK_BITS, 2 * cells)

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        cell, count = np.unique(np.concatenate(parts), return_counts=True)
        block = cell // size
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        low = (cell % size).astype("<u2")
        rows = []
        for a, b in zip(starts, np.append(starts[1:], len(cell))):
            one = count[a:b] == 1
            rows.append((int(block[a]), low[a:b][one].tobytes(), low[a:b][~one].tobytes()))
        return _batch(rows, "block int, once binary, more binary")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for n, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n:
                    parts.append(_cells(keys[:KEY * n], cells).ravel())
                    held += 2 * n
                if held > 2_000_000:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    def merge(rows: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.uint8)
        for once, more in zip(rows.column("once").to_pylist(), rows.column("more").to_pylist()):
            at = np.frombuffer(once, "<u2")
            counts[at] = np.minimum(counts[at] + 1, 2)
            counts[np.frombuffer(more, "<u2")] = 2
        return pa.table({"block": rows.column("block").slice(0, 1),
                         "bits": pa.array([np.packbits(counts == 2).tobytes()], pa.binary())})

    merged = paths.select("n", "keys").mapInArrow(count, "block int, once binary, more binary") \
        .groupBy("block").applyInArrow(merge, "block int, bits binary")
    bits = np.zeros(2 * cells // 8, np.uint8)
    for row in merged.collect():                  # bounded: the sketch's own size
        bits[row["block"] * (size // 8):(row["block"] + 1) * (size // 8)] = np.frombuffer(row["bits"], np.uint8)
    return bits


def _maybe_shared(keys: bytes, bits: np.ndarray) -> np.ndarray:
    """Prefixes whose estimate is two or more."""
    cell = _cells(keys, len(bits) * 4)
    return ((bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).all(axis=1)


# ---------------------------------------------------------------------------
# the trie
# ---------------------------------------------------------------------------

def _screened(paths: DataFrame, sent):
    """The two halves of the screened prefixes: ``(shared rows, nodes of single prefixes)``.
    A single prefix below a possibly shared one is left to the latter's row, which learns
    the parent."""

    def sections(batches):
        bits = sent.value
        for batch in batches:
            for conv, first, n, prev, keys, cum, before, rest in zip(*(c.to_pylist() for c in batch.columns)):
                if n:
                    shared = _maybe_shared(prev + keys, bits)
                    yield conv, first, n, shared[0] if prev else None, shared[1 if prev else 0:], keys, cum, before, rest

    def shared_rows(batches):
        for conv, first, n, _, shared, keys, cum, before, rest in sections(batches):
            at = np.flatnonzero(shared[:n])
            if not len(at):
                continue
            pairs = np.frombuffer(keys, "<i8").reshape(-1, 2)[at]
            totals = np.frombuffer(cum, "<i8")
            known = n + rest                         # entries from the section's first on, as far as known
            has_next = at + 1 < known
            alone = has_next & ~np.append(shared, True)[at + 1]
            cols = [pairs[:, 0], pairs[:, 1], np.full(len(at), conv), first + at,
                    np.append(before, totals)[at], totals[at], has_next, alone, at + 2 == known]
            yield pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in cols], names=_columns(SHARED))

    def single_nodes(batches):
        for conv, first, n, above, shared, _, _, _, rest in sections(batches):
            after = np.append(True if above is None else above, shared[:n - 1])   # parent possibly shared
            at = np.flatnonzero(~shared[:n] & (~after | (first + np.arange(n) == 1)))
            if not len(at):
                continue
            depth, one, last = first + at, np.ones(len(at), np.int64), at + 1 == n + rest
            ends = np.full(len(at), EMPTY_SHA, object)
            ends[last] = hashlib.sha256(str(conv).encode()).hexdigest()
            cols = [pa.array(one * conv), pa.array(depth), pa.array(one * conv, mask=depth == 1), pa.array(one),
                    pa.array((~last).astype(np.int64)), pa.array(one), pa.array(one * 0), pa.array(ends, pa.string())]
            yield pa.record_batch(cols, names=_columns(NODES))

    return paths.mapInArrow(shared_rows, SHARED), paths.mapInArrow(single_nodes, NODES)


def id_list_digests(rows: DataFrame, keys: list[str], id_col: str, chunk: int = CHUNK_IDS) -> DataFrame:
    """``(keys, ends_sha256)``: SHA-256 of each group's ids, ascending, joined by commas.

    Ranges of (keys, id) are sorted by many tasks, which join their ids to chunks; a group's
    chunks, one row for ``chunk`` ids, stream through the digest in order."""
    names = keys + [id_col]
    kinds = ", ".join(f"{k} long" for k in keys)
    n = parallelism(rows.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            new = np.zeros(len(cols[0]), bool)
            new[0] = True
            for c in cols[:-1]:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            out = []
            for a, b in zip(starts, np.append(starts[1:], len(new))):
                for lo in range(a, b, chunk):
                    ids = cols[-1][lo:min(b, lo + chunk)]
                    out.append((*(int(c[a]) for c in cols[:-1]), int(ids[0]), ",".join(map(str, ids.tolist()))))
            yield _batch(out, f"{kinds}, least long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sha, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in (*range(len(keys)), len(keys) + 1))):
                if key != group:
                    if group is not None:
                        out.append((*group, sha.hexdigest()))
                    group, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) > 10_000:
                yield _batch(out, f"{kinds}, ends_sha256 string")
                out = []
        if group is not None:
            out.append((*group, sha.hexdigest()))
        yield _batch(out, f"{kinds}, ends_sha256 string")

    chunks = rows.select(*names).repartitionByRange(n, *names).sortWithinPartitions(*names) \
        .mapInArrow(join, f"{kinds}, least long, ids string")
    return chunks.repartition(n, *keys).sortWithinPartitions(*keys, "least") \
        .mapInArrow(digest, f"{kinds}, ends_sha256 string")


def prefix_trie(paths: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """The trie's nodes from the sections of ``conversation_paths``: smallest member, depth,
    parent's smallest member, members, children, leaves of the subtree, saved bytes of the
    subtree, digest of the members that end there."""
    spark = paths.sparkSession
    paths = stage(paths, "trie-paths")
    least, n_prefixes = paths.agg(F.min("conv_id"), F.sum(F.col("n").cast("long"))).first()
    if least is None:
        return spark.createDataFrame([], NODES)
    cells = min(max_cells, max(MIN_CELLS, 1 << max(0, 4 * n_prefixes - 1).bit_length()))
    sent = spark.sparkContext.broadcast(prefix_sketch(paths, cells))
    shared, single = _screened(paths, sent)

    # exact grouping of the possibly shared prefixes; a hot prefix is summed before the
    # shuffle, and the join back is one that adaptive execution may split
    groups = shared.groupBy("k0", "k1").agg(
        F.min("conv_id").alias("m"), (F.count_if(~F.col("has_next")) == F.count(F.lit(1))).alias("childless"))
    members = stage(shared.join(groups, ["k0", "k1"]).drop("k0", "k1"), "trie-members")

    mine = F.col("m") == F.col("conv_id")
    of_conv = Window.partitionBy("conv_id")
    theirs = lambda c: F.when(~mine, c)
    rows = members.select(
        "*", F.max(theirs(F.col("depth"))).over(of_conv).alias("above"),         # deepest node of a smaller member
        F.max(theirs(F.struct("depth", "m"))).over(of_conv)["m"].alias("above_m"),
        F.max(theirs(F.col("cum"))).over(of_conv).alias("paid"),
        F.max(F.when(~F.col("has_next"), mine & F.col("childless"))).over(of_conv).alias("leaf"))
    parent = F.when(F.col("depth") == 1, F.lit(least)) \
        .when(F.col("depth") - 1 == F.col("above"), F.col("above_m")).otherwise(F.col("conv_id"))
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    # a path that ends below the exact rows ends in a single prefix, which is a leaf
    nodes = rows.groupBy("m", "depth").agg(
        F.max(F.when(mine, parent)).alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
        flag(F.col("has_next") & (mine | (F.col("depth") == F.col("above")))).alias("n_children"),
        flag(F.coalesce("leaf", F.lit(True))).alias("n_leaves"),
        F.sum(F.when(mine, 0).otherwise(F.col("paid") - F.col("before"))).cast("long").alias("saved_tokens"))
    nodes = stage(nodes, "trie-nodes")

    alone = F.col("next_last")
    heads = members.where("next_alone").select(
        "conv_id", (F.col("depth") + 1).alias("depth"), F.col("m").alias("parent_conv_id"), F.lit(1).alias("n_convs"),
        (~alone).cast("long").alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"),
        F.when(alone, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(EMPTY_SHA)
        .alias("ends_sha256"))

    single = single.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("parent_conv_id")))
    zero = F.lit(0)
    parts = paths.where("first = 1").select(F.lit(1).alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"),
                                            zero.alias("saved_tokens")) \
        .union(single.where("depth = 1").select(zero, F.lit(1), F.lit(1), zero)) \
        .union(nodes.where("depth = 1").select(zero, F.lit(1), "n_leaves", "saved_tokens"))
    root = parts.agg(*[F.sum(c).alias(c) for c in parts.columns]).select(
        F.lit(least).alias("m"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens")

    ended = members.where(~F.col("has_next")).select("m", "depth", "conv_id") \
        .union(paths.where("n = 0 and first = 1").select(F.lit(least), F.lit(0).cast("long"), "conv_id"))
    digests = id_list_digests(stage(ended, "trie-ends"), ["m", "depth"], "conv_id")
    grouped = nodes.unionByName(root).join(digests, ["m", "depth"], "left") \
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))).withColumnRenamed("m", "conv_id")
    names = _columns(NODES)
    out = single.select(names).union(heads.select(names)).union(grouped.select(names))
    return out.select(*[F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in names])
