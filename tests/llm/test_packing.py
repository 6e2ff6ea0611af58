import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from passagemill.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def plain_best_fit(lengths, capacity):
    """One piece after the other, the longest first, into the fullest sequence that has room."""
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= length
        else:
            rooms.append(capacity - length)
    return rooms


def placed(slots, counts):
    """sequence: (offset, length) of every rank."""
    out = defaultdict(list)
    by = defaultdict(list)
    for s in slots:
        by[s.length].append(s)
    for length, n in counts.items():
        for rank in range(n):
            s = max((s for s in by[length] if s.rank <= rank), key=lambda s: s.rank)
            k = rank - s.rank
            out[s.sequence + k // s.each].append((s.offset + k % s.each * length, length))
    return out


def gapless(sequences, capacity):
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity


def test_plan_over_counts_is_best_fit_over_pieces():
    rng = random.Random(3)
    for capacity in (1, 7, 64, 100):
        for _ in range(60):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 150))]
            if rng.random() < 0.5:
                lengths += [rng.randint(1, capacity)] * rng.randrange(200)
            counts = Counter(lengths)
            got = placed(packing.plan(counts, capacity), counts)
            gapless(got, capacity)
            rooms = sorted(capacity - sum(n for _, n in own) for own in got.values())
            assert rooms == sorted(plain_best_fit(lengths, capacity))


def test_plan_size_does_not_follow_the_counts():
    rng = random.Random(4)
    shape = {n: rng.randint(1, 9) for n in range(1, 2049)}
    small, large = packing.plan(shape), packing.plan({n: c * 10**9 for n, c in shape.items()})
    assert len(large) < 60_000 and len(small) < 60_000
    total = sum(n * c for n, c in shape.items()) * 10**9
    assert max(s.sequence for s in large) < 1.02 * total / 2048


def test_impossible_lengths():
    for counts, capacity in (({9: 1}, 8), ({0: 1}, 8), ({1: 1}, 0)):
        with pytest.raises(ValueError, match="fit|capacity"):
            packing.plan(counts, capacity)


def test_all_documents(spark, sf, library, shared):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = packing.pack(docs.repartition(5), PATH).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for doc_id, own in by.items():
        ids = [*library(texts[doc_id]), 0]
        want = [(i, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    gapless(sequences, 2048)
    assert len(sequences) == len(plain_best_fit([r.length for r in got], 2048))
    assert set(sequences) == set(range(len(sequences)))


def test_sequences_hold_the_ids(spark, shared, library):
    rows = [(i, f"word{i} of text {i}, it's number {i * i}! " * (i % 9)) for i in range(60)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, 50, with_ids=True)
    ids = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    got = defaultdict(list)
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id, r.piece)):
        assert ids[r.sequence_id][r.offset : r.offset + r.length] == r.ids
        got[r.doc_id] += r.ids
    assert {i: [*library(t), 0] for i, t in rows} == got
    assert all(0 < len(i) <= 50 for i in ids.values())


def test_white_space_and_marks(library):
    tokenizer = packing.WordTokenizer(PATH)
    rng = random.Random(5)
    bits = ["a", "The", "'s", "'", "12", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x85", "\xa0", "\x1c", " ", "　", "é", "é", "́", "ΑΣ", "ς", "İ", "!?", "<|endoftext|>", "日本", "🙂", "ﬁ", "ÀÉ", "ß×", "\u00ad", "½²", "ªº", "ÿŸ", "~|"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert np.frombuffer(tokenizer.encode(text.encode()), "<u4").tolist() == library(text)


def test_a_full_cache_is_emptied(library, monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 10)
    tokenizer = packing.WordTokenizer(PATH)
    for i in range(20):
        text = " ".join(f"w{j}" for j in range(i * 3, i * 3 + 9))
        assert np.frombuffer(tokenizer.encode(text.encode()), "<u4").tolist() == library(text)
        assert len(tokenizer.known) <= 10


def test_odd_rows(spark, shared, library):
    rows = [(1, None, 1), (2, "", 1), (3, "same", 1), (3, "same", 1), (None, "x", 1), (4, "ab " * 30_000, 1), (5, "q" * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(docs, PATH).collect()
    assert Counter(r.doc_id for r in got if r.doc_id not in (4, 5)) == {1: 1, 2: 1, 3: 2, None: 1}
    assert {r.length for r in got if r.doc_id in (1, 2)} == {1}
    for doc_id, text in ((4, rows[5][1]), (5, rows[6][1])):
        own = sorted((r.piece, r.length) for r in got if r.doc_id == doc_id)
        assert sum(n for _, n in own) == len(library(text)) + 1 and all(n == 2048 for _, n in own[:-1])
    assert packing.pack(docs.limit(0), PATH).count() == 0
    hot = spark.range(3000).selectExpr("id AS doc_id", "'one text that all have' AS text").repartition(7)
    full = packing.pack(hot, PATH).collect()
    places = defaultdict(list)
    for r in full:
        places[r.sequence_id].append((r.offset, r.length))
    gapless(places, 2048)
    assert len(full) == 3000 and len(places) == -(-3000 // (2048 // full[0].length))
