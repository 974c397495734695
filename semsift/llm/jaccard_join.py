"""Exact Jaccard self-join of shingle sets in their metric space (operator 4).

Jaccard distance is a metric, so a document's distances to a few pivots bound its
distances to others. Almost all documents of a corpus lie at distance 1 from each other,
where pivots tell nothing, so the space is first cut into islands that no link leaves:

1. a shingle found in one document only cannot be shared; a document with too few shared
   shingles to reach the threshold has no link and is done (most are);
2. of the rest, two linked documents must share one of their rarest shingles (as many as
   the threshold lets them differ by, and one); documents connected by such shingles
   form an island.

An island of up to ``leaf`` sets is joined in one task. A larger one is cut by pivots
drawn from it: each set belongs to the Voronoi region of its nearest pivot and is
replicated to every region whose pivot is at most two thresholds further, which holds all
its possible partners. Regions with more than ``leaf`` own sets are cut again by pivots of
their own; one that pivots cannot cut (equal distances) is cut into equal parts that all
see its boundary. In a region the own sets are held in blocks, sorted by distance to the
pivot, and the replicated ones stream past: only partners inside the triangle-inequality
window of a block are compared, each exactly, on whole sets.

A set's links are counted in the one region that owns it. Equal sets are one set with a
weight, so copies are never paired. No pair is put out: a region gives, per set, its
number of links and one edge to its group, and contraction of these edges gives the
components.

A document's set are its distinct ``k``-word shingles, a shorter one's is its whole
sequence; a null or empty text has none and is linked with nothing. Rows with equal ids
are separate; a component's id is its smallest id that is not null. Shingles and words
are represented by 64-bit hashes, whole texts are read, and an empty table gives none.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semsift.llm.common import parallelism, pick, release, stage, text_or_empty
from semsift.llm.components import connected_components
from semsift.llm.wordhash import shingle_hashes, slices, word_hashes

WORDS, PERCENT = 5, 75
#: A region is joined in one task up to this cost (its own sets' shingles, and 256 a set).
LEAF_COST, PIVOTS = 600_000, 16
#: Rows (of 64 bits) of the table that filters texts before they are shuffled.
FILTER_ROWS = 1 << 18
#: Own sets compared at once, and compared entries (pairs times shared shingles) held at once.
BLOCK_SETS, CHUNK = 512, 1 << 21

SCAN = ("block long, part int, hashes binary, counts binary, again binary, "
        "ids array<long>, t1 array<long>, t2 array<long>, n array<long>, shared binary")
COUNTED = ("block long, shared binary, ids array<long>, t1 array<long>, t2 array<long>, n array<long>")
LOW40 = np.uint64((1 << 40) - 1)


def _table(rows: list[dict], schema: str) -> list[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(),
             "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return [pa.record_batch([pa.array([r.get(n) for r in rows], kinds[t]) for n, t in fields],
                            names=[n for n, _ in fields])] if rows else []


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    words, at = word_hashes(texts)
    grams, gat = shingle_hashes(words, at, k)
    return [np.unique(grams[gat[i]:gat[i + 1]]) for i in range(len(texts))]


def _scan(k: int, parts: int):
    """Per block of documents, the block's shingles by part of the hash space, at 5 bytes
    each (one in 2^40 meets another by chance, which only lets a document through to the
    exact comparison), and one row that lists the block's documents. A shingle that two of
    the block's documents hold is known to be shared and sent once, without documents."""

    def block_rows(number: int, ids, t1, t2, sets: list[np.ndarray]) -> list[dict]:
        n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) & LOW40
        doc = np.repeat(np.arange(len(sets), dtype=np.uint32), n)
        order = np.argsort(flat, kind="stable")
        new = np.append(True, flat[order][1:] != flat[order][:-1]) if len(flat) else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(new), len(flat)))
        repeated = np.zeros(len(flat), bool)
        repeated[order] = np.repeat(size > 1, size)
        rows = [{"block": number, "part": number % parts, "ids": ids, "t1": t1, "t2": t2, "n": n,
                 "shared": np.bincount(doc[repeated], minlength=len(sets)).astype("<u4").tobytes()}]
        again = flat[order][new][size > 1]
        flat, doc = flat[~repeated], doc[~repeated]
        part, again_part = (flat >> np.uint64(8)) % np.uint64(parts), (again >> np.uint64(8)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")      # documents stay in order within a part
        flat, doc = flat[order], doc[order]
        edge = np.searchsorted(part[order], np.arange(parts + 1))
        again_edge = np.searchsorted(np.sort(again_part, kind="stable"), np.arange(parts + 1))
        again = again[np.argsort(again_part, kind="stable")]
        for p in range(parts):
            f, d, a = flat[edge[p]:edge[p + 1]], doc[edge[p]:edge[p + 1]], again[again_edge[p]:again_edge[p + 1]]
            if len(f) or len(a):
                rows.append({"block": number, "part": p, "hashes": _five(f), "again": _five(a),
                             "counts": np.bincount(d, minlength=len(sets)).astype("<u2").tobytes()
                             if n.max() < 1 << 16 else b"w" + np.bincount(d, minlength=len(sets)).astype("<u4").tobytes()})
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in slices(batch.column(3)):
                own = batch.slice(lo, hi - lo)
                ids, t1, t2 = (own.column(c).to_pylist() for c in range(3))
                yield from _table(block_rows(number, ids, t1, t2, _sets(own.column(3), k)), SCAN)
                number += 1

    return run


def _five(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(data: bytes) -> np.ndarray:
    eight = np.zeros((len(data) // 5, 8), np.uint8)
    eight[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return eight.reshape(-1).view("<u8")


def _count_shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """In a part of the hash space: how many of each document's shingles are found again."""
    rows = table.to_pylist()
    held = [r for r in rows if r["hashes"] is not None]
    hashes = [_from_five(r["hashes"]) for r in held]
    value, count = np.unique(np.concatenate(
        [*hashes, *[_from_five(r["again"]) for r in held], np.zeros(0, np.uint64)]), return_counts=True)
    value = value[count > 1]
    out = [r for r in rows if r["hashes"] is None]
    for r, own in zip(held, hashes):
        counts = r["counts"]
        counts = np.frombuffer(counts[1:], "<u4") if len(counts) % 2 else np.frombuffer(counts, "<u2")
        at = np.searchsorted(value, own)
        hit = np.zeros(len(own) + 1, np.int64)
        if len(value):
            hit[1:] = np.cumsum(value[np.minimum(at, len(value) - 1)] == own)
        end = np.cumsum(counts.astype(np.int64))
        shared = hit[end] - hit[end - counts]
        out.append({"block": r["block"], "shared": shared.astype("<u4").tobytes()})
    return pa.Table.from_batches(_table(out, COUNTED))


ROWS = "doc_id long, t1 long, t2 long, n long, shared long"


def _by_document(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    head = next(r for r in rows if r["ids"] is not None)
    shared = sum(np.frombuffer(r["shared"], "<u4").astype(np.int64) for r in rows)
    return pa.table({"doc_id": pa.array(head["ids"], pa.int64()), "t1": pa.array(head["t1"], pa.int64()),
                     "t2": pa.array(head["t2"], pa.int64()), "n": pa.array(head["n"], pa.int64()),
                     "shared": pa.array(shared, pa.int64())})


SET_ROWS = "t1 long, t2 long, key binary, n long, data binary"


def _survivor_sets(k: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                own = batch.slice(lo, hi - lo)
                yield from _table([{"t1": a, "t2": b, "key": xxhash.xxh3_128(s.tobytes()).digest(), "n": len(s),
                                    "data": s.tobytes()}
                                   for a, b, s in zip(own.column(0).to_pylist(), own.column(1).to_pylist(),
                                                      _sets(own.column(2), k))], SET_ROWS)

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        for lo, hi in slices(batch.column(2), 8 << 20):
            data = b"".join(batch.column(2).slice(lo, hi - lo).to_pylist())
            yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy()[lo:hi], sizes[lo:hi])),
                                   pa.array(np.frombuffer(data, "<i8"))], names=["node", "h"])


def islands_of(sets: DataFrame, percent: int) -> DataFrame:
    """``(node, island)`` of the sets (``node, n, data``) that share one of their rarest
    shingles with another: as many of them as two linked sets may differ by, and one."""
    tokens = sets.select("node", "n", "data").mapInArrow(_tokens, "node long, h long")
    tokens = stage(tokens, "join-tokens")
    found = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # shingles of one set come first in its order and can match nothing, so only their
    # number matters: what is left of the prefix is filled by the rarest shared ones
    ranked = tokens.join(found, "h").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("df", "h"))).alias("by_df"))
    may_differ = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    take = (may_differ - (F.col("n") - F.size("by_df"))).cast("int")
    prefix = ranked.join(sets.select("node", "n"), "node").where(take > 0) \
        .select("node", F.explode(F.slice("by_df", 1, take)).alias("x")).select("node", "x.h")
    prefix = stage(prefix, "join-prefixes")
    hub = prefix.groupBy("h").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1")
    edges = prefix.join(hub, "h").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    islands = stage(connected_components(edges).withColumnRenamed("component", "island"), "join-islands")
    release(tokens, prefix)
    return islands


# ---- comparing sets inside a task

class _Index:
    """Shingles of a block of sets, by value."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.value, self.owner, self.size = flat[order], owner[order], len(sets)

    def overlaps(self, others: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        """``(first, counts)``: ``counts[i, j]`` shingles are in both ``others[first + i]``
        and set ``j``; as many rows at a time as ``CHUNK`` allows."""
        lo = np.concatenate([np.searchsorted(self.value, o, "left") for o in others])
        hi = np.concatenate([np.searchsorted(self.value, o, "right") for o in others])
        of = np.repeat(np.arange(len(others)), [len(o) for o in others])
        size = hi - lo
        work = np.cumsum(np.bincount(of, weights=size, minlength=len(others)) + self.size)
        first = 0
        while first < len(others):
            base = work[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(work, base + CHUNK, "right")))
            a, b = np.searchsorted(of, [first, end])
            s = size[a:b]
            before = np.cumsum(s) - s
            at = np.arange(int(s.sum())) - np.repeat(before - lo[a:b], s)
            cell = np.repeat((of[a:b] - first) * self.size, s) + self.owner[at]
            yield first, np.bincount(cell, minlength=(end - first) * self.size).reshape(end - first, self.size)
            first = end


def _distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    n, m = np.array([len(s) for s in sets]), np.array([len(p) for p in pivots])
    out = np.empty((len(sets), len(pivots)))
    for first, both in _Index(pivots).overlaps(sets):
        rows = slice(first, first + len(both))
        out[rows] = 1 - both / (n[rows, None] + m[None, :] - both)
    return out


REGION = "region long, own boolean, node long, weight long, dist double, data binary"


def _assign(percent: int, level: int):
    """Voronoi regions of a salted part of a region's sets (left) and its pivots (right)."""
    reach = 2 * (1 - percent / 100) + 1e-9

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        members = left.to_pylist()
        pivots = sorted(right.to_pylist(), key=lambda r: r["p_node"])
        if not members:
            return pa.Table.from_batches([], _schema())
        d = _distances([np.frombuffer(r["data"], "<u8") for r in members],
                       [np.frombuffer(r["p_data"], "<u8") for r in pivots])
        home, out = d.argmin(1), []
        for r, row, h in zip(members, d, home):
            for j in np.flatnonzero(row <= row[h] + reach):
                out.append({"region": pivots[j]["p_node"] * 64 + level, "own": bool(r["own"] and j == h),
                            "node": r["node"], "weight": r["weight"], "dist": float(row[j]), "data": r["data"]})
        return pa.Table.from_batches(_table(out, REGION))

    return run


def _schema() -> pa.Schema:
    return pa.schema([("region", pa.int64()), ("own", pa.bool_()), ("node", pa.int64()),
                      ("weight", pa.int64()), ("dist", pa.float64()), ("data", pa.binary())])


def cut_regions(rows: DataFrame, percent: int, leaf_cost: int = LEAF_COST,
                pivots: int = PIVOTS) -> tuple[DataFrame, bool]:
    """Cuts regions (``REGION`` rows) until each one's own sets cost at most ``leaf_cost``;
    whether any was cut. Sizes are looked at on the driver only as one maximum a level."""
    done, level, any_cut = [], 1, False
    cost = F.octet_length("data") / 8 + 256
    parent = None
    while True:
        sizes = rows.groupBy("region").agg(
            F.sum(F.when(F.col("own"), cost).otherwise(0)).cast("long").alias("cost"),
            F.sum(F.col("own").cast("long")).alias("sets"), F.sum(cost).cast("long").alias("all_cost"),
            F.min(F.when(F.col("own"), F.col("node"))).alias("first"))
        sizes = stage(sizes.where((F.col("cost") > leaf_cost) & (F.col("sets") > 1)), "region-sizes")
        largest = sizes.agg(F.max("cost")).first()[0]
        if largest is None:
            done.append(rows)
            break
        any_cut = True
        done.append(rows.join(sizes.select("region"), "region", "left_anti"))
        large = rows.join(sizes, "region")
        if parent is not None and largest > 0.7 * parent or level >= 60:
            # pivots cannot tell these sets apart: equal parts, each beside all others
            m = F.ceil(F.col("cost") / leaf_cost).cast("int")
            mine = F.pmod(F.xxhash64("node"), m)
            rows = large.withColumn("_m", mine).withColumn("_p", F.explode(F.sequence(F.lit(0), (m - 1).cast("int")))) \
                .select(F.xxhash64("region", "_p").alias("region"),
                        (F.col("own") & (F.col("_m") == F.col("_p"))).alias("own"), "node", "weight", "dist", "data")
            done.append(stage(rows, "region-parts"))
            break
        salts = F.ceil(F.col("all_cost") / leaf_cost).cast("int")
        salted = large.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(level)), salts).cast("int"))
        chosen = large.where(F.col("own") & ((F.col("node") == F.col("first")) | (
            F.pmod(F.xxhash64("node", F.lit(-level)), F.col("sets")) < pivots)))
        chosen = chosen.select(F.col("region").alias("p_region"), F.col("node").alias("p_node"),
                               F.col("data").alias("p_data"),
                               F.explode(F.sequence(F.lit(0), salts - 1)).alias("p_salt"))
        rows = stage(salted.select("region", "salt", "own", "node", "weight", "data").groupBy("region", "salt")
                     .cogroup(chosen.groupBy("p_region", "p_salt")).applyInArrow(_assign(percent, level), REGION),
                     "regions")
        parent, level = largest, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, any_cut


LINKED = "node long, own boolean, links long, top long"


class _Groups:
    """Union-find over the sets of a region."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, a: int) -> int:
        up = self.up
        while up.setdefault(a, a) != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


class _Region:
    """Links of one region: its own sets are held, the others stream past."""

    def __init__(self, percent: int):
        self.percent = percent
        self.sets, self.nodes, self.weights, self.dists = [], [], [], []
        self.blocks = None
        self.seen: list[int] = []

    def own(self, node, weight, dist, data) -> None:
        self.sets.append(data)
        self.nodes.append(node)
        self.weights.append(weight)
        self.dists.append(dist)

    def _ready(self) -> None:
        if self.blocks is not None:
            return
        if self.sets and self.dists[0] is None:    # an island of one region: its first set is the pivot
            self.pivot = self.sets[0]
            self.dists = _distances(self.sets, [self.pivot])[:, 0].tolist()
        order = np.argsort(np.array(self.dists, float), kind="stable")
        self.sets = [self.sets[i] for i in order]
        self.nodes, self.weights, self.dists = (np.array(x)[order] for x in (self.nodes, self.weights, self.dists))
        self.n = np.array([len(s) for s in self.sets])
        self.links = np.zeros(len(self.sets), np.int64)
        self.groups = _Groups()
        self.blocks = [(lo, min(lo + BLOCK_SETS, len(self.sets)), _Index(self.sets[lo:lo + BLOCK_SETS]))
                       for lo in range(0, len(self.sets), BLOCK_SETS)]
        self.compare(self.nodes, self.weights, self.dists, self.sets)

    def compare(self, nodes, weights, dists, sets) -> None:
        """Finds the links between the own sets and these."""
        self._ready() if self.blocks is None else None
        reach = 1 - self.percent / 100 + 1e-9
        n = np.array([len(s) for s in sets])
        for lo, hi, index in self.blocks:
            near = np.flatnonzero((dists >= self.dists[lo] - reach) & (dists <= self.dists[hi - 1] + reach))
            if not len(near):
                continue
            for first, both in index.overlaps([sets[i] for i in near]):
                at = near[first:first + len(both)]
                either = n[at][:, None] + self.n[None, lo:hi] - both
                linked = (100 * both >= self.percent * either) & (nodes[at][:, None] != self.nodes[None, lo:hi])
                self.links[lo:hi] += (linked * weights[at][:, None]).sum(0)
                x, y = np.nonzero(linked)
                for a, b in zip(nodes[at[x]].tolist(), self.nodes[lo + y].tolist()):
                    self.groups.join(a, b)

    def rows(self) -> list[dict]:
        self._ready()
        own = set(self.nodes.tolist())
        out = [{"node": v, "own": True, "links": int(c), "top": self.groups.find(v)}
               for v, c in zip(self.nodes.tolist(), self.links)]
        return out + [{"node": v, "own": False, "links": 0, "top": self.groups.find(v)}
                      for v in list(self.groups.up) if v not in own]


def _join_regions(percent: int):
    """Regions arrive one after the other, each with its own sets first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, key = None, None
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo] != key:
                    if region is not None:
                        out += region.rows()
                    region, key = _Region(percent), keys[lo]
                own = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                node, weight = (batch.column(c).slice(lo, hi - lo).to_numpy() for c in (2, 3))
                dist = batch.column(4).slice(lo, hi - lo).to_pylist()
                data = [np.frombuffer(x, "<u8") for x in batch.column(5).slice(lo, hi - lo).to_pylist()]
                n_own = int(own.sum())
                for i in range(n_own):
                    region.own(int(node[i]), int(weight[i]), dist[i], data[i])
                if n_own < hi - lo:
                    region.compare(node[n_own:], weight[n_own:], np.array(dist[n_own:], float), data[n_own:])
            yield from _table(out, LINKED)
        if region is not None:
            yield from _table(region.rows(), LINKED)

    return run


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                  percent: int = PERCENT, leaf_cost: int = LEAF_COST) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, n_links``."""
    spark = docs.sparkSession
    parts = parallelism(spark)
    text = text_or_empty("text")
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit("text"), text).alias("t2"), text.alias("text"))
    scanned = rows.mapInArrow(_scan(words, parts), SCAN).repartition(parts, "part")
    counted = scanned.groupBy("part").applyInArrow(_count_shared, COUNTED) \
        .groupBy("block").applyInArrow(_by_document, ROWS)
    small = stage(counted, "join-documents")
    needed = F.ceil(F.col("n") * percent / 100)
    keys = small.where((F.col("n") > 0) & (F.col("shared") >= needed)).groupBy("t1", "t2") \
        .agg(F.count(F.lit(1)).alias("rows"))
    keys = stage(keys, "join-survivors")
    # a table of bits with at most FILTER_ROWS rows keeps most other texts out of the
    # shuffle; what it lets through by chance the exact join removes (keys are distinct, so
    # an inner join does; Spark would move a semi join in front of the filter)
    slot, bit = F.pmod("t1", F.lit(FILTER_ROWS)), F.expr("shiftleft(1L, CAST(pmod(t2, 64) AS INT))")
    bits = stage(keys.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")), "join-filter")
    maybe = rows.join(F.broadcast(bits), slot == F.col("slot")).where(F.col("bits").bitwiseAND(bit) != 0)
    texts = maybe.join(keys.select("t1", "t2"), ["t1", "t2"]).select("t1", "t2", "text")
    of_text = stage(texts.mapInArrow(_survivor_sets(words), SET_ROWS), "join-sets")
    by_key = of_text.select("t1", "t2", "key").distinct().join(keys, ["t1", "t2"])
    weights = by_key.groupBy("key").agg(F.sum("rows").alias("weight"))
    sets = of_text.groupBy("key").agg(F.first("n").alias("n"), F.first("data").alias("data")).join(weights, "key")
    sets = stage(sets.withColumn("node", F.monotonically_increasing_id()), "join-nodes")
    islands = islands_of(sets, percent)
    regions = sets.join(islands, "node").select(
        (F.col("island") * 64).alias("region"), F.lit(True).alias("own"), "node", "weight",
        F.lit(None).cast("double").alias("dist"), "data")
    whole_islands = stage(regions, "regions")
    regions, any_cut = cut_regions(whole_islands, percent, leaf_cost)
    linked = regions.repartition(parts, "region") \
        .sortWithinPartitions("region", F.desc("own"), "dist", "node").mapInArrow(_join_regions(percent), LINKED)
    linked = stage(linked, "join-links")
    release(whole_islands, islands)
    top = linked.where("own").select("node", "top")
    if any_cut:    # sets of a cut island are linked across its regions
        edges = linked.select(F.col("node").alias("a"), F.col("top").alias("b"))
        whole = connected_components(edges)
        top = top.join(whole, "node", "left").select("node", F.coalesce("component", "top").alias("top"))
    found = linked.where("own").select("node", "links").join(top, "node")
    found = sets.select("node", "key", "weight").join(found, "node", "left").select(
        "key", F.coalesce("top", "node").alias("top"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    result = stage(of_text.select("t1", "t2", "key").distinct().join(found, "key"), "join-result")
    in_group = small.join(result, ["t1", "t2"], "left")
    in_group = stage(in_group.select("doc_id", "n", "top", "links"), "join-groups")
    first = stage(in_group.where("top is not null").groupBy("top").agg(F.min("doc_id").alias("component_id")),
                  "join-first")
    return in_group.join(first, "top", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents whose id is their component's, with the columns of ``docs``. Rows that
    share an id count as one document; rows without an id are their own and stay."""
    links = jaccard_links(docs, id_col, text_col, words, percent)
    gone = stage(links.where("doc_id != component_id").select(F.col("doc_id").alias("_j_gone")).distinct(),
                 "join-gone")
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("_j_gone"), "left_anti")
