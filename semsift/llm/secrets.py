"""Secret scan with corpus-wide ownership frequency (operator 1).

Every text is searched for assignments, access keys and long hex runs, and for other
long random-looking strings. The hash of each candidate is counted over the distinct
repositories and owners that carry it: what many owners share is a copied example, what
one owner has in few repositories and looks random is taken for a live credential, and the
rest (two owners, or one that copies it widely) is unclear. The random-looking
strings are reported only where that count finds them live; the first three kinds
always are.

Counts are aggregated before they are shuffled, so a candidate that a third of all
documents carry arrives as one row per task, repository and owner; verdicts return to
their documents in a join that adaptive execution can split. Texts are read once and
never moved, nor are candidates: only hashes and positions are kept.

A null text is empty; a null repository or owner counts as one of its own name. Repeated
rows are reported each, and count once for ownership. An empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semsift.llm.common import pick, stage

# fixed patterns of the scan
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Bits per character from which a string looks random.
MIN_BITS = 3.3
#: Owners from which a candidate is a copied example.
EXAMPLE_OWNERS = 3
#: Repositories up to which one owner's candidate may be live.
LIVE_REPOS = 3

FOUND = ("row long, doc_id long, repo string, owner string, n_assign long, n_access long, n_hex long, "
         "base_sha256 string, found array<struct<start:int,kind:int,end:int,hash:string,looks_live:boolean,first:boolean>>")


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_live(value: str) -> bool:
    return entropy(value) >= MIN_BITS and any(c.isdigit() for c in value)


def find_base(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, secret)`` of the three fixed kinds, by start, then kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if max(map(len, text.split()), default=0) >= MIN_ACCESS:  # neither kind contains white space
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= MIN_HEX]
    return sorted(found)


def find_random(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Other long strings of mixed characters that touch no base span."""
    if max(map(len, text.split()), default=0) < 20:
        return []
    taken = [(s, e) for s, _, e, _ in base]
    return [(m.start(), 3, m.end(), m[0]) for m in RANDOM.finditer(text)
            if looks_live(m[0]) and any(c.isalpha() for c in m[0])
            and not any(s < m.end() and m.start() < e for s, e in taken)]


def spans_text(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()),
                      ("hash", pa.string()), ("looks_live", pa.bool_()), ("first", pa.bool_())])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(),
             pa.string(), pa.list_(span)]
    names = ["row", "doc_id", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"]
    for batch in batches:
        rows = []
        head = [batch.column(k).to_pylist() for k in range(4)]
        texts = batch.column(4)
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            base = find_base(text)
            more = sorted(base + find_random(text, base))
            n, first = Counter(k for _, k, _, _ in base), {v: s for s, _, _, v in reversed(more)}
            rows.append((*(h[i] for h in head), n[0], n[1], n[2],
                         hashlib.sha256(spans_text(base).encode()).hexdigest(),
                         [{"start": s, "kind": k, "end": e, "looks_live": looks_live(v), "first": first[v] == s,
                           "hash": hashlib.sha256(v.encode()).hexdigest()[:32]} for s, k, e, v in more]))
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "repo",
                 owner_col: str = "owner", example_owners: int = EXAMPLE_OWNERS,
                 live_repos: int = LIVE_REPOS) -> tuple[DataFrame, DataFrame]:
    """``(documents, ownership)``.

    ``documents``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example`` (candidates found live, and found to be copied examples), one row per
    input row. ``ownership``: ``hash, repos, owners, documents,
    verdict`` for every candidate."""
    rows = pick(docs, _id=id_col, _repo=repo_col, _owner=owner_col, _text=text_col).select(
        F.monotonically_increasing_id().alias("row"), F.col("_id").cast("long").alias("doc_id"),
        F.col("_repo").cast("string").alias("repo"), F.col("_owner").cast("string").alias("owner"), "_text")
    scanned = stage(rows.mapInArrow(_scan, FOUND), "secret-scan")
    hits = scanned.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("f")) \
        .select("row", "repo", "owner", "f.*")
    owned = (hits.groupBy("hash", F.coalesce("owner", F.lit("")).alias("owner"),
                          F.coalesce("repo", F.lit("")).alias("repo"))
             .agg(F.max("looks_live").alias("looks_live"), F.count_if("first").alias("documents")))
    by_owner = owned.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("documents").alias("documents"),
                                                  F.max("looks_live").alias("looks_live"))
    ownership = stage(by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"),
        F.sum("documents").alias("documents"), F.max("looks_live").alias("looks_live")).select(
        "hash", "repos", "owners", "documents", F.when(F.col("owners") >= example_owners, "example")
        .when((F.col("owners") == 1) & (F.col("repos") <= live_repos) & F.col("looks_live"), "live").otherwise("unclear").alias("verdict")),
        "secret-owners")
    judged = hits.join(ownership.select("hash", "verdict", "owners"), "hash")
    shown = F.filter("judged", lambda s: (s["kind"] < 3) | (s["verdict"] == "live"))
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda verdict: F.size(F.filter("judged", lambda s: s["verdict"] == verdict)).cast("long")
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "verdict"))).alias("judged")).select(
        "row", count("live").alias("n_live"), count("example").alias("n_example"),
        F.array_join(F.transform(shown, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))
    out = scanned.drop("found").join(per_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))
    return out, ownership
