import hashlib
import random
import re

from passagemill.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(1)
    bits = ["a@", "b", "@", "c.d", "_x", "1.2.3.4", ".5", "256", "+1", "(9", "0)", " 555", "-12", "4111111111111111", " ", "é", "..", "1", "2"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == plain_base(text)


def test_all_documents(spark, sf, shared):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = pii.find(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone"))
        assert set(f"{k}:{a}:{b}" for k, a, b in base) <= set(r.spans.split(","))


def test_secrets_are_added_and_words_are_not(spark, shared):
    rng = random.Random(2)
    token = lambda: "".join(rng.choice("abcdef1234") for _ in range(40))
    rows = [(i, f'the token = "{token()}" of it, in version-1-of-the-long-winded-name') for i in range(40)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all([s.split(":")[0] for s in r.spans.split(",")] == ["secret"] for r in got)


def test_odd_rows(spark, shared):
    long_text = "a" * 200_000 + " x@y.com " + "1" * 100_000 + "(" * 50_000
    rows = [(1, None, 1, "k"), (2, "", 2, "k"), (3, "x@y.com x@y.com", 3, "k"), (3, "x@y.com x@y.com", 3, "k"), (None, "+1 (555) 123-4567", 0, "k"), (4, long_text, 9, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert pii.find(docs).count() == 6
    assert got[1].spans == got[2].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == "email:0:7,email:8:15" and got[None].n_phone == 1 and got[4].n_email == 1
    clean = {(r.doc_id, r.text, r.n_chars, r.spans) for r in pii.redact(docs).collect() if r.doc_id != 4}
    assert clean == {(1, None, None, "k"), (2, "", 0, "k"), (3, "[EMAIL] [EMAIL]", 15, "k"), (None, "[PHONE]", 7, "k")}
    assert pii.find(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


def test_long_tokens_are_whole_candidates():
    rng = random.Random(9)
    for n in (19, 20, 128, 129, 300, 5000):
        token = "A1b" + "".join(rng.choice("abcdefXYZ0123456789+/") for _ in range(n - 3))
        found = [s for s in pii.loose_spans(f"key = {token}, and words") if s[0] == "secret"]
        assert found == ([("secret", 6, 6 + n)] if n >= 20 else [])
    assert not [s for s in pii.loose_spans("a" * 300_000 + " " + "1" * 300_000) if s[0] == "secret"]
