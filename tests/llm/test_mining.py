"""Phrases, token counts and the conversation trie against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm.helpers import awkward, documents, empty, planted, with_clashes

# ---- phrases


def brute_phrases(rows, least, max_words=5, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").encode().lower().decode()):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            for m in range(1, max_words + 1):
                counts[lang].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {g: c for g, c in f.items() if c >= least and len(g) > 1}
        drop = {g[i:i + m] for g, c in often.items() for m in range(2, len(g)) for i in range(len(g) - m + 1)
                if 100 * c >= 100 * f[g[i:i + m]]}
        found = []
        for g, a in often.items():
            if g not in drop:
                score, k = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("cells, ranges, block", [(None, 1 << 21, 1 << 16), (0, 50, 3), (1 << 16, 1 << 10, 64)])
def test_phrases(spark, monkeypatch, cells, ranges, block):
    """Screened and not, in one range and many, in one block and many."""
    from semsift.llm import phrases
    monkeypatch.setattr(phrases, "RANGE_WORDS", ranges)
    monkeypatch.setattr(phrases, "BUILD_BLOCK", block)
    if cells == 0:
        cells, _ = None, monkeypatch.setattr(phrases, "USELESS_LOAD", 0)
    docs = planted(spark).unionByName(awkward(spark))
    got = sorted(tuple(r) for r in phrases.collocations(with_clashes(docs), least=12, cells=cells).collect())
    want = brute_phrases([(r["lang"], r["text"]) for r in docs.collect()], 12)
    assert got == want and len(got) > 50


def test_phrases_small(spark, monkeypatch):
    """Ties, overlaps, a long text in blocks, pieces, cuts, and phrases inside longer ones."""
    from semsift.llm import phrases
    monkeypatch.setattr(phrases, "TEXT_BLOCK", 64)
    rows = [("en", "A b c. a B c; a b\td! a b\nc a a a a"), (None, "x y, x y: x y"), ("und", "x y"), ("en", None), ("en", ""),
            ("de", "eins zwei " * 40 + ". " + "eins zwei drei, " * 60), ("en", "é ü é ü\x0bé ü")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=2).collect())
    assert got == brute_phrases(rows, 2)
    assert ("und", 1, "x y", 4, 4, 4, 8, 2000) in got
    assert phrases.collocations(empty(spark)).collect() == []


def test_count_transducer():
    """Paths and counts come back, equal states are one, composition finds the counts."""
    from semsift.llm import phrases
    rng = np.random.default_rng(3)
    rows = rng.integers(1, 6, (400, 4)).astype(np.uint64)
    rows[rng.random(400) < 0.3, 3] = 0
    rows, counts = np.unique(rows, axis=0, return_counts=True)
    built = phrases.build_transducer(rows, counts, 2)
    layers = phrases.unpack(built.pack())
    want = Counter()
    for r, c in zip(rows.tolist(), counts.tolist()):
        r = [x for x in r if x]
        for d in range(2, len(r) + 1):
            want[tuple(r[:d])] += c
    paths = phrases.all_paths(layers)
    assert {tuple(p): int(w) for rows_, ws in paths[1:] for p, w in zip(rows_.tolist(), ws)} == want
    for rows_, ws in paths[1:]:
        assert (phrases.compose(layers, rows_) == ws).all()
    assert (phrases.compose(layers, np.array([[1, 9], [9, 1]], np.uint64)) == 0).all()
    same = np.array([[a, 7, b, 0] for a in range(1, 50) for b in (2, 3)], np.uint64)
    assert len(phrases.unpack(phrases.build_transducer(same, np.ones(98, np.int64), 3).pack())[2][1]) == 2


# ---- token counts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts(spark, tokenizer):
    from semsift.llm.token_counts import count_tokens
    path, library = tokenizer
    docs = documents(spark).unionByName(awkward(spark))
    got = sorted((tuple(r) for r in count_tokens(with_clashes(docs), path).collect()), key=repr)
    want = []
    for r in docs.collect():
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        want.append((r["doc_id"], len(text.encode()), n, n > 512))
    assert [g[:4] for g in got] == sorted(want, key=repr)
    assert all(0 <= g[4] <= g[2] for g in got) and sum(g[4] for g in got) > 0
    none = count_tokens(empty(spark), path)
    assert none.collect() == [] and none.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_direct"]


def test_token_counter_on_odd_strings(tokenizer, monkeypatch):
    from semsift.llm import token_counts
    path, library = tokenizer
    with open(path, encoding="utf-8") as file:
        source = file.read()
    whole = token_counts.prove_whole_tokens(source)
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in whole[::7] if t.strip())
    counters = [token_counts.TokenCounter(source, whole), token_counts.TokenCounter(source, whole, 5)]
    monkeypatch.setattr(token_counts, "MAX_KNOWN", 3)
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t ", "word", "I'll", "'s", "''s", "12", "٣", "é", "日本語", "　", " ", "\x1c", "\x85",
             "<|endoftext|>", "<|endof", "🙂", "\U0001e900", "ა", "...", "!?", "Zyxwvut"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert [c(text)[0] for c in counters] == [n, n], text


def test_split_classes(tokenizer):
    """Outside ``UNSURE`` every character is split as the tokenizer splits it."""
    import regex
    from semsift.llm.token_counts import PATTERN, UNSURE
    pre, pattern, unsure = tokenizer[1].pre_tokenizer, regex.compile(PATTERN), regex.compile(UNSURE)
    for code in [*range(0xD800), *range(0xE000, 0x10000), *range(0x1F000, 0x1FB00)]:
        c = chr(code)
        if not unsure.match(c):
            text = f"a{c}a 1{c}1 .{c}. {c}{c} "
            assert [len(x) for x in pattern.findall(text)] == [b - a for _, (a, b) in pre.pre_tokenize_str(text)], hex(code)


# ---- conversation trie


def brute_trie(rows, family=5, openings=9):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % openings
        built[c] = convs.get(c - c % family, [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))))) for k, m in nodes.items()),
                  key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def random_turns(seed, n=60, longest=14):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-10, 150), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user",
                         rng.choice(["hi", "ho", "é" * rng.randint(1, 3)]) if rng.random() < 0.8 else f"own {c} {t}"))
    return rows


@pytest.mark.parametrize("cells, section", [(1 << 27, 8192), (1 << 16, 3), (64, 1)])
def test_prefix_trie(spark, cells, section):
    """Also with a sketch full of collisions and with sections of a turn."""
    from semsift.llm import prefix_trie as pt
    rows = random_turns(section) + [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, "a"), (8, 3, "user", "hi"),
                                    (8, 3, "user", "hi"), (8, 3, "user", "ha"), (1005, 0, "user", ""), (1006, 0, "user", "z")]
    turns = with_clashes(spark.createDataFrame(rows, TURNS))
    paths = pt.conversation_paths(turns, family=5, openings=9, section=section)
    got = pt.prefix_trie(paths, max_cells=cells)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_trie(rows)


def test_prefix_trie_copies_and_edges(spark):
    from semsift.llm import prefix_trie as pt
    rows = [(c, t, "user", f"same {t}") for c in range(40) for t in range(12)] + [(50, t, "user", f"t{t}") for t in range(30)]
    turns = spark.createDataFrame(rows, TURNS)
    got = sorted((tuple(r) for r in pt.prefix_trie(pt.conversation_paths(turns)).collect()), key=repr)
    assert got == brute_trie(rows, 1, 1)
    none = pt.prefix_trie(pt.conversation_paths(spark.createDataFrame([], TURNS)))
    assert none.collect() == [] and none.columns == [c.split()[0] for c in pt.NODES.split(", ")]
    only_null = spark.createDataFrame([(None, 1, "user", "x")], TURNS)
    assert pt.prefix_trie(pt.conversation_paths(only_null)).collect() == []
    turnless = spark.createDataFrame([(5, 0, "u", "a"), (6, 0, "u", "b")], TURNS)
    found = pt.prefix_trie(pt.conversation_paths(turnless, family=5, openings=9))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_trie([(5, 0, "u", "a"), (6, 0, "u", "b")])
