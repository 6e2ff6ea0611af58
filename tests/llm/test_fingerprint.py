import hashlib
import random

import numpy as np

from passagemill.llm import fingerprint as fp


def plain_hash(text):
    return "".join([f"{len(text):08x}", *(f"{sum((ord(c) + 1) * pow(b, j, fp.PRIME) for j, c in enumerate(text)) % fp.PRIME:08x}" for b in fp.BASES)])


def test_prefix_arrays_answer_spans_and_extensions(monkeypatch):
    monkeypatch.setattr(fp, "_BLOCK", 7)
    monkeypatch.setattr(fp, "_POWERS", [fp._powers(b) for b in fp.BASES])
    rng = random.Random(3)
    for _ in range(150):
        a, b = ("".join(rng.choice("ab🙂") for _ in range(rng.randrange(40))) for _ in range(2))
        x, y = fp.PrefixHashes.of(a), fp.PrefixHashes.of(b)
        assert x.fingerprint() == plain_hash(a)
        i, j = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        k = rng.randrange(min(len(a) - i, len(b) - j) + 1)
        assert x.same(i, y, j, k) == (a[i : i + k] == b[j : j + k])
        common = 0
        while i + common < len(a) and j + common < len(b) and a[i + common] == b[j + common]:
            common += 1
        assert x.extension(i, y, j) == common
        assert 0 <= fp.likeness(x, y) <= 1 and fp.likeness(x, x) == 1 and fp.likeness(x, y) == fp.likeness(y, x)


def plain_edited(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for n, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(n + 1) % len(rows)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_hash(text), plain_hash(edited)))
    return sorted(out, key=str)


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = fp.edited_fingerprints(docs).collect()
    few = [r for r in got if r.n_chars < 4000]
    want = {r[0]: r for r in plain_edited([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])}
    assert len(got) == len(want) and all(tuple(r)[:5] == want[r.doc_id] for r in few)
    assert np.mean([r.near_edited for r in got]) > 0.6 > np.mean([r.near_next for r in got])


def test_odd_rows_at_any_number_of_parts(spark):
    rows = [(5, "same"), (5, "same"), (5, None), (None, "no id"), (None, ""), (-3, "x"), (9, "ab" * 60_000), (7, ""), (8, "🙂é" * 10)]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, part string")
    for parts in (1, 3, 50):
        got = sorted((tuple(r)[:5] for r in fp.edited_fingerprints(docs, parts).collect()), key=str)
        want = plain_edited(rows)
        assert [g[:3] for g in got] == [w[:3] for w in want]
    assert fp.edited_fingerprints(docs.limit(1)).count() == 1 and fp.edited_fingerprints(docs.limit(0)).count() == 0
    assert fp.fingerprints(docs).columns == ["doc_id", "n_chars", "fingerprint"] and fp.fingerprints(docs).count() == len(rows)
