import hashlib

import corpus_pipeline
from passagemill.llm import pii, toxicity
from tests.llm.test_decontamination import plain as plain_contaminated
from tests.llm.test_near_duplicates import plain_kept


def test_stages_by_brute_force(spark, sf, shared):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    docs = read("documents")
    items = [(r.item_id, r.text) for r in read("benchmark").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score(docs, toxicity.train(docs, read("labels"))).collect() if r.is_toxic}
    left = {i: t for i, t in texts.items() if i not in toxic}
    left = dict(plain_kept(list(left.items())))
    held = {i for i, _ in plain_contaminated(left.items(), items)}
    left = {i: t for i, t in left.items() if i not in held}
    assert toxic and held and len(left) < len(texts)

    step = docs
    seen = []
    for name, function in corpus_pipeline.STAGES:
        made = function(spark, step, sf)
        if name != "tokens":
            assert made.columns == docs.columns and made.dtypes == docs.dtypes
        path = f"{shared}/test-{name}"
        made.write.mode("overwrite").parquet(path)
        step = spark.read.parquet(path)
        seen.append({r.doc_id for r in step.select("doc_id").collect()})
    assert seen[0] == set(texts) - toxic and seen[3] == seen[2] == seen[4] == set(left)
    probability = pii.learn(pii.candidates(spark.createDataFrame(list(left.items()), "doc_id long, text string")))
    masked = {i: pii._redacted(t, probability) for i, t in left.items()}
    assert {r.doc_id: r.text for r in spark.read.parquet(f"{shared}/test-personal_data").collect()} == masked
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in masked.items()}
    assert {r.doc_id: r.decoded_sha256 for r in step.collect()} == want
    assert {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_odd_rows_pass_every_stage(spark, sf, shared):
    text = "one two three four five six"
    rows = [(None, text, None, None, None), (None, text, "en", "s", 1), (None, "nothing like it at all", "en", "s", 1), (5, text, "en", "s", 1), (6, None, "en", None, None), (7, "", None, "s", 0), (8, "w " * 100_000, "en", "s", 9)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids int")
    for name, function in corpus_pipeline.STAGES:
        for part in (docs, docs.limit(0)):
            made = function(spark, part, sf)
            if name != "tokens":
                assert made.columns == docs.columns
            n = made.count()
            assert n == (0 if part is not docs else {"near_duplicates": 4}.get(name, len(rows)))
    kept = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect() if r.doc_id != 8)
    assert kept == [("5", text), ("6", None), ("None", "nothing like it at all")]


def test_columns_of_any_name_pass_every_stage(spark, sf, shared):
    rows = [(1, "one two three four five six"), (1, "quite another text of the same id"), (None, "a third one"), (2, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1L AS n_chars", *[f"1 AS `{n}`" for n in ("node", "_node", "row", "keys", "held", "_held", "_going", "_dup_row", "_slot", "is_toxic", "a.b")])
    for name, function in corpus_pipeline.STAGES[:-1]:
        made = function(spark, docs, sf)
        assert made.columns == docs.columns
        assert made.count() == (3 if name == "near_duplicates" else 4)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 4
