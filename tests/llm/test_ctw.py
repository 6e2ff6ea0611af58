import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from passagemill.llm import ctw


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def symbols_of(text, depth):
    out = [ctw.START] * depth
    for w in (text or "").encode().lower().split():
        out += [*w, ctw.END]
    return out + [ctw.END]


def plain_ctw(train, depth):
    """Context-tree weighting from its definition, one dictionary of counts; returns log10 P(text)."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for text in train:
        s = symbols_of(text, depth)
        for i in range(depth, len(s)):
            for k in range(9):
                node, bit = 1 << k | s[i] >> (9 - k), s[i] >> (8 - k) & 1
                for d in range(depth + 1):
                    context = tuple(s[i - d : i])
                    counts[node, context][bit] += 1
                    if d:
                        children[node, context[1:]].add(context)

    def kt(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(n0 + n1 + 1)

    @lru_cache(None)
    def weighted(node, context):
        own = kt(*counts[node, context]) if (node, context) in counts else 0.0
        if len(context) == depth:
            return own
        below = sum(weighted(node, c) for c in children.get((node, context), ()))
        return float(np.logaddexp(own, below)) - math.log(2)

    def one(node, history, d=0):
        context = tuple(history[len(history) - d :])
        n0, n1 = counts.get((node, context), (0, 0))
        estimate = (n1 + 0.5) / (n0 + n1 + 1)
        if d == depth:
            return estimate
        w = math.exp(kt(n0, n1) - math.log(2) - weighted(node, context))
        return w * estimate + (1 - w) * one(node, history, d + 1)

    def score(text):
        s, total = symbols_of(text, depth), 0.0
        for i in range(depth, len(s)):
            for k in range(9):
                p = one(1 << k | s[i] >> (9 - k), s[i - depth : i])
                total += math.log10(p if s[i] >> (8 - k) & 1 else 1 - p)
        return total

    return score


def small_docs(n=40, seed=1):
    rng = random.Random(seed)
    words = ["the", "then", "é", "a\x00b", "Tho", "of"]
    return [(i, " \n".join(rng.choice(words) for _ in range(rng.randrange(6)))) for i in range(n)] + [(n, None), (n + 1, "unseen zz")]


@pytest.mark.parametrize("depth", [3, 5])
def test_scores_match_the_definition(spark, shared, depth):
    rows = small_docs()
    got = {r.doc_id: r for r in ctw.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), depth, blocks=3).collect()}
    plain = plain_ctw([t for i, t in rows if not is_held_out(i)], depth)
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i].score == pytest.approx(plain(text), rel=1e-5)


def test_word_model_matches_the_formula(spark, sf, shared):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, [*r.text.encode().lower().split(), b""]) for r in docs.collect()]
    counts = Counter(w for i, words in rows if not is_held_out(i) for w in words)
    n = counts.total()
    got = {r.doc_id: r for r in ctw.score_documents(docs).collect()}
    for i, words in rows:
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in words)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held_out(i), len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(base) and r.bits_per_byte > 0


def test_held_out_documents_beat_the_word_model(spark, shared):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = [r for r in ctw.score_documents(docs).collect() if r.held_out]
    assert np.mean([r.score for r in held]) > np.mean([r.base_score for r in held])
    assert np.mean([r.score > r.base_score for r in held]) > 0.8


def test_odd_rows(spark, shared):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t", "x"), (4, "one two", "x"), (4, "one two", "x"), (None, "one", "x"), (5, "long word " * 50_000 + "w" * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = ctw.score_documents(docs, blocks=2).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and by[1].score == by[2].score
    assert by[None].held_out is False and by[5].n_tokens == 100_002
    assert ctw.score_documents(docs.limit(0)).count() == 0


def test_lookup_and_counts():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 54, 5000)
    counts = ctw.Counts()
    for part in np.array_split(np.concatenate([values, values[:700], values[:100]]), 7):
        counts.add(part)
        counts.settle()
    want = Counter(np.concatenate([values, values[:700], values[:100]]).tolist())
    assert dict(zip(counts.keys.tolist(), counts.n.tolist())) == want
    table = ctw.Lookup(counts.keys, counts.n)
    assert table[values[:999]].tolist() == [want[int(v)] for v in values[:999]]


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e3, 1e9])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)
