import random
from collections import Counter

import pytest

from passagemill.llm import decontamination as d
from pyspark.sql import functions as F


def plain(docs, items, least=0.8):
    """Every window of every item's size, compared by its bag of word runs."""
    runs = lambda text: [" ".join(w[i : i + 5]) for w in [(text or "").lower().split()] for i in range(len(w) - 4)]
    out = {}
    for doc_id, text in docs:
        own = runs(text)
        for item_id, other in items:
            item = runs(other)
            if not own or not item:
                continue
            a = Counter(item)
            for start in range(max(1, len(own) - len(item) + 1)):
                b = Counter(own[start : start + len(item)])
                common = sum((a & b).values())
                s = common / (a.total() + b.total() - common)
                if s >= least and s > out.get((doc_id, item_id), 0):
                    out[doc_id, item_id] = s
    return out


def planted(seed=4):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(30, 60)))) for i in range(12)]
    docs = []
    for i in range(90):
        words = [word() for _ in range(rng.randrange(20, 200))]
        if i % 3 == 0:
            passage = items[i % 12][1].split()
            if i % 2:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = passage
        docs.append((i, " ".join(words)))
    return docs, items


def test_all_windows_of_planted_passages(spark):
    docs, items = planted()
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    assert found == pytest.approx(plain(docs, items)) and len(found) >= 20


def test_windows_that_line_up_nowhere_near_the_best_place(spark):
    rng = random.Random(8)
    item = [f"w{i}" for i in range(59)]
    filler = lambda n: [f"f{rng.randrange(10**6)}" for _ in range(n)]
    swapped = item[30:] + item[:30]
    docs = [(i, " ".join(filler(a) + swapped + filler(b))) for i, (a, b) in enumerate([(40, 50), (0, 50), (40, 0), (0, 0), (3, 2)])]
    docs += [(10, " ".join(filler(20) + item[40:] + item[20:40] + item[:20] + filler(9))), (11, " ".join(filler(5) + item[9:] + filler(70) + item[:9]))]
    items = [(1, " ".join(item)), (2, " ".join(filler(40)))]
    got = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    assert found == pytest.approx(plain(docs, items)) and set(found) >= {(i, 1) for i in range(5)}


def test_long_documents_are_cut_with_overlap(spark, monkeypatch):
    docs, items = planted()
    args = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in d.contaminated(*args).collect()}
    monkeypatch.setattr(d, "CHUNK", 7)
    assert {tuple(r) for r in d.contaminated(*args).collect()} == whole
    monkeypatch.setattr(d, "BROADCAST_SHINGLES", 0)
    assert {tuple(r) for r in d.contaminated(*args).collect()} == whole


def test_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    docs = [(1, None, 5), (2, "", 5), (3, f"  {text.upper()}\t\n", 5), (3, text, 5), (None, text, 5), (4, "one two three four", 5), (5, f"{text} " * 20_000, 5)]
    items = [(7, text, 1), (7, text, 1), (8, None, 1), (9, "one two", 1), (None, text, 1)]
    a = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.similarity, r.start) for r in d.contaminated(a, b).collect()}
    assert got == {(i, j, 1.0, 0) for i in (3, None, 5) for j in (7, None)}
    left = d.without_benchmark(a, b)
    assert left.columns == a.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 4]
    assert d.contaminated(a.limit(0), b).count() == 0 and d.without_benchmark(a, b.limit(0)).count() == len(docs)


def test_rows_are_judged_by_their_own_text(spark):
    item = " ".join(f"w{i}" for i in range(40))
    rows = [(None, f"before it {item} after", "a"), (None, "clean and of no id at all", "b"), (3, f"{item} then", "c"), (3, "clean and of the same id", "d"), (4, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held string").withColumn("_held", F.lit(1)).withColumn("a.b", F.lit(2))
    left = d.without_benchmark(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r.held for r in left.collect()) == ["b", "d", "e"]


def test_blocks_cover_all_bits_and_guarantee_the_radius():
    masks = d._masks(20)
    assert len(masks) == 21 and sum(m % (1 << 64) for m in masks) == (1 << 64) - 1


def test_no_python_in_the_plan(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = d.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_simhash_is_the_majority(spark):
    rng = random.Random(6)
    hashes = [rng.getrandbits(64) - (1 << 63) for _ in range(9)]
    got = spark.range(1).select(d.simhash(F.array(*[F.lit(h) for h in hashes])).alias("f")).first().f
    assert got % (1 << 64) == sum(1 << b for b in range(64) if sum(h % (1 << 64) >> b & 1 for h in hashes) > 4)
