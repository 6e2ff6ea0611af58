import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from passagemill.llm import chat, queries

PARTS = "array<struct<kind:string,text:string,ref:string,units:long>>"
HARD = st.text(alphabet="\\<|>a\n:0e", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(HARD, max_size=4), HARD)
def test_any_text_comes_back(texts, role):
    parts = [{"kind": "text", "text": t, "ref": None, "units": None} for t in texts]
    rendered, loss, _ = chat.render_turn(role, parts, learn_from=role)
    assert chat.parse_turn(rendered) == (role, "".join(texts))
    assert [chat.unescape(rendered[s["start"] : s["end"]]) for s in loss] == texts
    assert rendered.count(chat.TURN) == rendered.count(chat.END) == 1


def test_typed_parts():
    parts = [
        {"kind": "text", "text": "see <|image:0|>", "ref": None, "units": None},
        {"kind": "image", "text": None, "ref": "a.png", "units": 4},
        {"kind": "audio", "text": None, "ref": None, "units": None},
        {"kind": "video", "text": None, "ref": "v", "units": 3},
        {"kind": None, "text": " end", "ref": None, "units": None},
    ]
    rendered, loss, attached = chat.render_turn("assistant", parts)
    assert rendered == "<|turn|>assistant<|text|>see <\\|image:0|><|image:0|><|audio:1|><|other:2|> end<|end|>"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in attached] == [("image", "a.png", 1024), ("audio", "", 25), ("other", "v", 3)]
    assert all(rendered[a["start"] :].startswith(f"<|{a['kind']}:{a['ordinal']}|>") for a in attached)
    assert [rendered[s["start"] : s["end"]] for s in loss] == ["see <\\|image:0|>", " end"]
    assert chat.parse_turn(rendered) == ("assistant", "see <|image:0|> end")


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_all_conversations(spark, sf):
    words = r"\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain([*rows, (-7, 0, "user", words), (-7, 1, "assistant", words)])
    got = queries.op6_chat_formatting(spark, sf).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, 1), (1, 1, None, "x", 1), (1, None, "assistant", "", 1), (None, 0, "assistant", "y" * 200_000, 1), (2, 5, "user", "same", 1), (2, 5, "user", "same", 1)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered int")
    parted = talks.withColumn("parts", chat.text_part(talks.text))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_turns(parted)).collect()}
    assert got == plain(rows)
    typed = spark.createDataFrame([(1, 0, "user", None), (1, 1, "user", [None, ("image", None, "r", 2)])], f"conv_id long, turn long, role string, parts {PARTS}")
    back = chat.read_back(chat.format_turns(typed)).first()
    assert (back.n_turns, back.n_attachments, back.attachment_tokens) == (2, 1, 512)
    assert chat.read_back(chat.format_turns(parted.limit(0))).count() == 0
