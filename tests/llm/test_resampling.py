import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from passagemill.llm import queries, resampling
from tests.oracle import compare, duck

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, target, buckets=10_000, longest=1, seed=2024, least=20, percent=10):
    words = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    runs = lambda ws: [crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]
    own, wanted = [runs(ws) for ws in words], Counter(b for t in target for b in runs(WORD.findall((t or "").translate(LOWER))))
    s = Counter(b for bs in own for b in bs)
    total, goal = sum(s.values()), sum(wanted.values())
    out = []
    for (doc_id, _), bs, ws in zip(rows, own, words):
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets)))) for b in bs)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = Counter()
    ranks = {}
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks.setdefault(tuple(r), []).append(place)
    got = []
    for r in out:
        places = ranks.get(tuple(r), [])
        k = drawn[tuple(r)]
        drawn[tuple(r)] += 1
        got.append((*r[:4], places[k] if k < len(places) else None))
    return sorted(got, key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_all_documents(spark, sf, shared):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*("doc_id", "text") if t == "documents" else ("item_id", "text")).collect()]
    assert rows_of(queries.op12_importance_resampling(spark, sf)) == plain(read("documents"), [t for _, t in read("benchmark")])


def test_sql(spark, sf, shared):
    assert compare(spark, duck(sf), sf, queries.op12_importance_resampling, resampling.SQL) is None


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_cutoff_at_every_place_with_ties_and_copies(spark, shared, monkeypatch, few):
    monkeypatch.setattr(resampling, "BLOCK", 40)
    rng = random.Random(few)
    rows = [(rng.choice([None, *range(150)]), 5, 0, rng.choice([7] * 6 + list(range(12))), 30, i) for i in range(400)]
    keys = resampling.stage(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long, n_words long, row long").repartition(6), "keys")
    order = sorted((-s, d is None, d or 0, n, row) for d, n, _, s, _, row in rows)
    for place in (1, 2, 133, 200, 399, 400):
        assert resampling.cutoff(keys, place, few) == tuple(map(int, order[place - 1]))
    assert resampling.cutoff(keys, 0, few) is None and resampling.cutoff(keys, 401, few) is None
    last = tuple(map(int, order[199]))
    got = [(r.rank, r.score, r.doc_id) for r in resampling.ranked(keys, last).collect()]
    assert [r for r, _, _ in sorted(got)] == list(range(1, 201))
    assert [(-s, d is None, d or 0) for _, s, d in sorted(got)] == [k[:3] for k in order[:200]]


def test_a_weighted_median_leaves_a_quarter_on_either_side():
    rng = random.Random(1)
    for _ in range(200):
        parts = [sorted(rng.sample(range(10**6), rng.randrange(1, 60))) for _ in range(rng.randrange(1, 20))]
        pivot = resampling.weighted_median([(len(p), (p[(len(p) - 1) // 2], 0, 0, 0, 0)) for p in parts])[0]
        every = [x for p in parts for x in p]
        assert sum(x <= pivot for x in every) * 4 >= len(every) and sum(x >= pivot for x in every) * 4 >= len(every)


def test_longer_runs_and_other_parameters(spark, shared):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab cd Ef gh é1 x-y Z".split()) for _ in range(rng.randrange(40)))) for i in range(120)]
    target = ["ab cd ab cd ef", None, "é1"]
    docs, goal = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, goal, buckets=64, longest=3, seed=9, least_words=5, percent=35)
    assert rows_of(got) == plain(rows, target, 64, 3, 9, 5, 35)


def test_odd_rows(spark, shared):
    long_text = "Word number " * 100_000
    rows = [(None, "a b c " * 9), (None, None), (1, ""), (2, "x " * 30), (2, "x " * 30), (2, "y " * 40), (3, long_text), (4, "\x00 A-Z \x7f{}"), *[(9, "z " * 25)] * 8]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, score string")
    goal = spark.createDataFrame([("x y",)], "text string")
    for percent in (0, 10, 50, 100):
        assert rows_of(resampling.resample(docs, goal, percent=percent)) == plain(rows, ["x y"], percent=percent)
    assert rows_of(resampling.resample(docs, goal.limit(0))) == plain(rows, [])
    assert resampling.resample(docs.limit(0), goal).count() == 0
    for wrong in ({"buckets": 0}, {"longest": 0}, {"percent": 101}):
        with pytest.raises(ValueError, match="buckets"):
            resampling.resample(docs, goal, **wrong)
