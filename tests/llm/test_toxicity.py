import random
import zlib

import numpy as np

from passagemill.llm import toxicity


def fixture(n=400, seed=1):
    rng = random.Random(seed)
    plain = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    bad = ["awful", "nasty", "vile", "rotten"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for w in rng.sample(bad, rng.randrange(1, 4)):
                words[rng.randrange(60)] = w
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(d, toxicity.train(d, l)).collect()}
    unseen = [i for i, _ in docs if i % 2]
    assert np.mean([rows[i].is_toxic == (i % 5 == 0) for i in unseen]) > 0.97
    kept = {r.doc_id for r in toxicity.without_toxic(d, l).collect()}
    assert kept == {i for i in rows if not rows[i].is_toxic}


def test_later_models_get_out_of_fold_probabilities():
    rng = np.random.default_rng(3)
    x = np.hstack([np.ones((600, 1)), rng.normal(size=(600, 4))])
    first = (x[:, 1] + rng.normal(size=600) > 0).astype(float)
    y = np.stack([first, first * (rng.random(600) < 0.9), np.zeros(600)], axis=1)
    weights, constants, held_out = toxicity.fit_chain(x, y, np.arange(600) % 5)
    assert [len(w) for w in weights] == [5, 6, 0] and constants[2] < 0.01
    for f in range(5):  # by hand: the first category's model of the other folds
        inside = np.arange(600) % 5 != f
        w = toxicity.fit_linear(x[inside], y[inside, 0])
        assert np.allclose(held_out[~inside, 0], 1 / (1 + np.exp(-x[~inside] @ w)))
    later = np.hstack([x, toxicity._logits(held_out[:, :1])])
    assert np.allclose(weights[1], toxicity.fit_linear(later, y[:, 1]))


def test_query_against_its_definition(spark):
    """Probabilities of all documents by fitting the chain here, from the features of the labelled ones."""
    docs, labels = fixture(300)
    docs += [(1000 + i, docs[i][1]) for i in range(0, 60, 2)]  # copies, labelled like their originals
    labels += [(1000 + i, 1, int(i % 5 == 0)) for i in range(0, 60, 2)]
    labels = [(i, int(i % 7 != 0), t) for i, _, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    chain = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: (r.p_low_quality, r.p_toxic, r.is_toxic) for r in toxicity.score(d, chain).collect()}
    text, marks = dict(docs), {i: (1 - q, t) for i, q, t in labels}
    ids = sorted(marks)
    x = chain.features([text[i] for i in ids])
    folds = np.array([zlib.crc32(text[i].encode()) % 5 for i in ids])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    low, toxic = (np.array([marks[i][c] for i in ids], float) for c in (0, 1))
    held_out = np.zeros(len(ids))
    for f in range(5):
        held_out[folds == f] = sigmoid(x[folds == f] @ toxicity.fit_linear(x[folds != f], low[folds != f]))
    first = toxicity.fit_linear(x, low)
    second = toxicity.fit_linear(np.column_stack([x, toxicity._logits(held_out)]), toxic)
    every = chain.features([t for _, t in docs])
    p_low = sigmoid(every @ first)
    p_toxic = sigmoid(np.column_stack([every, toxicity._logits(p_low)]) @ second)
    assert len(got) == len(docs)
    for (i, _), a, b in zip(docs, p_low, p_toxic):
        assert np.allclose(got[i][:2], (a, b), atol=1e-9) and got[i][2] == (b >= 0.5)


def test_real_labels(spark):
    sf = "/root/testdata/sf0.01"
    d, l = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.is_toxic for r in toxicity.score(d, toxicity.train(d, l)).collect()}
    truth = {r.doc_id: r.toxic for r in l.collect()}
    assert np.mean([rows[i] == bool(t) for i, t in truth.items()]) > 0.99


def test_odd_rows(spark):
    docs, labels = fixture(100)
    rows = [*((i, t, 1) for i, t in docs), (None, None, 1), (501, "", 1), (502, "vile " * 100_000, 1), (502, "vile " * 100_000, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    l = spark.createDataFrame([*labels, (None, 1, 1), (2, None, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(d, l)
    got = toxicity.score(d, chain).collect()
    assert len(got) == len(rows) and len({r.p_toxic for r in got if r.doc_id == 502}) == 1
    assert toxicity.without_toxic(d, l).columns == d.columns
    for few in (l.limit(0), l.where("toxic = 0")):
        assert not any(r.is_toxic for r in toxicity.score(d, toxicity.train(d, few)).collect())
    assert toxicity.without_toxic(d.limit(0), l).count() == 0
