import random
import re

import numpy as np
import xxhash

from passagemill.llm import simhash
from passagemill.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius=4):
    """fps: {id: fingerprint}; the smallest id that steps reach."""
    left, out = set(fps), {}
    while left:
        todo, seen = [min(left)], {min(left)}
        while todo:
            x = todo.pop()
            new = {y for y in left - seen if (fps[x] ^ fps[y]).bit_count() <= radius}
            seen |= new
            todo.extend(new)
        out.update(dict.fromkeys(seen, min(seen)))
        left -= seen
    return out


def plain_groups(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    root = plain_components(fps)
    return {(i, f"{fps[i]:016x}", root[i]) for i in fps}


def near_texts(n, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(n):
        words = list(base) if i % 3 else [f"x{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"y{rng.randrange(100)}"
        out.append((i * 7 + 1, " ".join(words)))
    return out


def test_documents_match_brute_force(spark, sf, shared):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in simhash.groups(docs).collect()}
    assert got == plain_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_dense_keys_take_the_other_exact_way(spark, shared):
    rows = near_texts(240)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows)
    assert len({c for _, _, c in want}) < 200
    for dense in (1, 5, 4096):
        assert {tuple(r) for r in simhash.groups(docs, dense=dense).collect()} == want


def test_odd_rows(spark, shared):
    long_text = "the same four words " * 30_000
    rows = [(3, None, 1), (2, "", 1), (5, " \t\n", 1), (9, "One two", 1), (8, "one TWO", 1), (None, "one two", 1), (4, long_text, 1), (4, long_text, 1), (7, "ÄÖ ä", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumnRenamed("fp", "component_id")
    got = sorted((tuple(r) for r in simhash.groups(docs).collect()), key=str)
    assert len(got) == len(rows)
    by = {}
    for i, f, c in got:
        by.setdefault(i, set()).add((f, c))
    assert by[3] == by[2] == by[5] == {("0" * 16, 2)}
    assert {c for _, c in by[9] | by[8] | by[None]} == {8}
    assert len(by[4]) == 1 and next(iter(by[4]))[1] == 4
    assert simhash.groups(docs.limit(0)).count() == 0


def test_keys_guarantee_the_radius():
    rng = np.random.default_rng(5)
    for _ in range(400):
        x = int(rng.integers(0, 2**64, dtype=np.uint64))
        y = x
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            y ^= 1 << int(b)
        a, b = (set(simhash.keys_of(np.array([v], np.uint64))[0].tolist()) for v in (x, y))
        assert a & b


def test_components_of_chains_and_stars(spark, shared):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 20)] + [(50, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 1 for i in range(1, 20)) and 50 not in got
