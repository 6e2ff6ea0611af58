import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from passagemill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("leaf_bytes", "leaf_chars"), [(32, 1 << 15), (2, 5), (1, 17)])
def test_any_split_gives_the_library_tokens(library, monkeypatch, leaf_bytes, leaf_chars):
    monkeypatch.setattr(bpe, "LEAF_BYTES", leaf_bytes)
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf_chars)
    own = bpe.Bpe({t: r for t, r in bpe.load(PATH, public_tokenizers.PATTERN).ranks.items()}, public_tokenizers.PATTERN)
    rng = random.Random(7)
    bits = ["'", "s", "re", "ll", " ", "  ", "\n", "é", "a", "the", "123", "!", "...", "\t", "ing", "T", "　", "x" * 9, "日本", "🙂", "=" * 30, "aa"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text) and own.decode(ids) == text.encode()
    for _ in range(60):
        text = "".join(rng.choice("abcdethinsé") for _ in range(rng.randrange(100, 600))) + "a" * rng.randrange(300)
        assert own.encode(text) == library.encode_ordinary(text)


def test_all_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = bpe.round_trip(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, library):
    long_text = "ab" * 100_000 + " " * 50_000 + "end"
    rows = [(1, None, 5), (2, "", 5), (3, "same", 5), (3, "same", 5), (None, "x", 5), (4, long_text, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    encoded = bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)
    by = {r.doc_id: r.ids for r in encoded.collect()}
    assert by[1] == by[2] == [] and by[3] == library.encode_ordinary("same") and by[4] == library.encode_ordinary(long_text)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(encoded, PATH, public_tokenizers.PATTERN).collect()}
    assert back[4] == long_text.encode() and back[None] == b"x"
    assert bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).count() == 6
    assert bpe.round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
