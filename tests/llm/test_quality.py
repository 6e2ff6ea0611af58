import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from passagemill.llm import quality
from passagemill.llm.common import Scratch


def plain_model(texts, order):
    """The same model from its definition, on tuples of symbols and with dictionaries; returns P(last symbol | those before)."""
    levels = {order: Counter(g for t in texts for g in plain_grams(t, order))}
    for k in range(order - 1, 0, -1):
        left = defaultdict(set)
        for g in levels[k + 1]:
            left[g[1:]].add(g)
        levels[k] = {g: len(x) for g, x in left.items()}
    cost, under = {}, {}
    for k, counts in levels.items():
        n = [sum(c == i for c in counts.values()) for i in range(5)]
        if all(n[1:]):
            y = n[1] / (n[1] + 2 * n[2])
            cost[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i) for i in (1, 2, 3)]
        else:
            cost[k] = [0.5, 1.0, 1.5]
        for g, c in counts.items():
            under.setdefault(g[:-1], []).append(c)

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / quality.SYMBOLS
        below = p(gram[1:])
        counts = under.get(gram[:-1])
        if not counts:
            return below
        spare = sum(cost[k][min(c, 3) - 1] for c in counts)
        c = levels[k].get(gram, 0)
        return (max(c - cost[k][min(c, 3) - 1], 0) if c else 0) / sum(counts) + spare / sum(counts) * below

    return p


def plain_grams(text, order):
    symbols = [256] * (order - 1) + list(text.encode()) + [256]
    return [tuple(symbols[i : i + order]) for i in range(len(text.encode()) + 1)]


def packed(gram):
    return sum(s << quality.BITS * i for i, s in enumerate(reversed(gram)))


def test_grams_come_in_pieces(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(quality, "_PIECE", 7)
    for n in (0, 1, 2, 5, 6, 7, 8, 13, 14, 15, 60):
        text = "".join(rng.choice("ab\u00e9\u4e2d") for _ in range(n))
        assert [int(g) for piece in quality.grams_of(text.encode()) for g in piece] == [packed(g) for g in plain_grams(text, quality.ORDER)]


def test_model_matches_its_definition(spark, shared):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aaabbc d\u4e2d") for _ in range(rng.randrange(40))) for _ in range(30)] + [""]
    docs = spark.createDataFrame([(bytearray(t.encode()), True) for t in texts], "text binary, trusted boolean")
    p = plain_model(texts, 3)
    asked = {*plain_grams("abcadzbb\u4e2d\u5b57", 3), *(tuple(rng.choice((97, 98, 120, 256)) for _ in range(3)) for _ in range(40)), *((97, 98, s) for s in range(257))}
    with Scratch(spark) as scratch:
        levels = quality.train(quality.count_grams(docs, 3), scratch, 3)
        got = quality.probabilities(spark.createDataFrame([(packed(g),) for g in asked], "gram long"), levels, scratch).collect()
    assert len(got) == len(asked)
    by = {r.gram: r.p for r in got}
    for gram in asked:
        assert by[packed(gram)] == pytest.approx(p(gram), rel=1e-9)
    assert sum(by[packed((97, 98, s))] for s in range(257)) == pytest.approx(1)


def test_query_against_brute_force(spark, shared, monkeypatch):
    """Perplexities, limits of each language and keep, over several blocks and scripts."""
    rng = random.Random(8)
    words = {"xx": "one two three four five".split(), "yy": "\u4e2d\u6587 \u5b57\u7b26 \u00e9t\u00e9 na\u00efve".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 30))) + ("#@!" * (i % 9 == 0)), lang) for i in range(90) for lang in [rng.choice(("xx", "yy"))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = {i for i in range(90) if i % 9 and i % 2}
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2_000)
    labels = spark.createDataFrame([(i, int(i in trusted), 0) for i in range(0, 90)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels, 0.1, 0.9, enough=5).collect()}
    p = plain_model([t for i, t, _ in rows if i in trusted], quality.ORDER)
    logs = {i: sum(math.log10(p(g)) for g in plain_grams(t, quality.ORDER)) for i, t, _ in rows}
    cells = {i: -logs[i] / (len(t.encode()) + 1) * 10_000 for i, t, _ in rows}
    assert len(got) == 90 and {r.limits_of for r in got.values()} == {"language"}
    for i, text, lang in rows:
        assert got[i].symbols == len(text.encode()) + 1 and got[i].log10_prob == pytest.approx(logs[i], rel=1e-9)
        own = sorted(round(cells[j]) for j, _, other in rows if other == lang and j in trusted)
        low, high = own[math.ceil(0.1 * len(own)) - 1], own[math.ceil(0.9 * len(own)) - 1]
        assert got[i].keep == (low <= round(cells[i]) <= high)
        assert got[i].low == pytest.approx(10 ** (low / 10_000)) and got[i].high == pytest.approx(10 ** (high / 10_000))


def test_junk_is_found_in_held_out_documents(spark, shared):
    sf = "/root/testdata/sf0.1"  # a small model knows its own texts better than others
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.doc_id % 2}
    assert len(got) == docs.count()
    good, bad = [[got[i].keep for i, q in truth.items() if q == x] for x in (1, 0)]
    assert np.mean(good) > 0.93 and np.mean(bad) < 0.2


def test_odd_rows(spark, shared):
    text = "some plain words of a language"
    rows = [*((i, f"{text} {i}", "en", 1) for i in range(60)), (100, None, None, 1), (101, "", "xx", 1), (1, f"{text} 1", "en", 1), (None, text, "en", 1), (102, "#@!" * 100_000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(7, 1, 0), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[100].symbols == by[101].symbols == 1 and not by[102].keep and by[2].keep
    assert all(r.keep for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_no_lower_limit_at_zero(spark, shared):
    text = "some plain words of a language"
    docs = spark.createDataFrame([*((i, f"{text} {i} {text}", "en") for i in range(60)), (100, text, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    by = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert by[100].perplexity < min(by[i].perplexity for i in range(60)) and by[100].keep and by[100].low == 0


def test_limits_are_the_language_s_own_if_it_has_enough_trusted_documents(spark, shared):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("one two three four five six".split()) for _ in range(30))
    docs = spark.createDataFrame([(i, text(), "xx" if i < 40 else "yy") for i in range(50)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    for enough, small in ((30, "all"), (10, "language"), (11, "all")):
        got = quality.classify(docs, labels, enough=enough).collect()
        assert {(r.lang, r.limits_of) for r in got} == {("xx", "language"), ("yy", small)}


def test_the_model_is_gone_before_the_texts_are_shuffled(spark, shared, monkeypatch):
    staged, there = [], []
    stage, perplexities = Scratch.stage, quality.perplexities

    def look(docs, known, *rest):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        files = hadoop(staged[0]).getFileSystem(spark._jsc.hadoopConfiguration())
        there.extend(path for path in staged if files.exists(hadoop(path)))
        return perplexities(docs, known, *rest)

    def noted(self, df, name):
        frame = stage(self, df, name)
        staged.append(self.paths[-1])
        return frame

    monkeypatch.setattr(Scratch, "stage", noted)
    monkeypatch.setattr(quality, "perplexities", look)
    docs = spark.createDataFrame([(i, f"some words {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert quality.classify(docs, labels).count() == 20
    assert len(staged) > 10 and [path.rsplit("/", 1)[1].split("-")[0] for path in there] == ["known"]


def test_texts_are_shuffled_compressed():
    texts = [b"", b"a", "many words of a text that is like others, ".encode() * 300, bytes(range(256)) * 40, "ä中".encode()] * 150
    frame = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    small = pa.Table.from_batches(quality.zipped(iter([frame])))
    assert small.column("doc_id").to_pylist() == list(range(len(texts))) and list(quality.unzipped(small)) == texts
    assert sum(map(len, small.column("text").to_pylist())) < sum(map(len, texts)) / 10
