"""Personal data by weak supervision: labelers vote on candidate spans, EM learns whom to believe, a classifier decides.

1. Candidates. Fixed rules give the base spans (they always stay); looser patterns give further candidates:
   card-like and phone-like numbers, key-like tokens, spelled-out mail addresses.
2. Labelers. For each candidate six labelers vote yes, no or nothing: shape rules (regex), lists (gazetteer) and
   words around it (context).
3. Label model. All votes of the corpus are counted by pattern in one distributed sum; the number of patterns
   is bounded by the number of labelers. Expectation-maximisation on these counts estimates how often each
   labeler says what for true and false candidates.
4. Span classifier. A logistic regression on votes and shape bits, trained on the label model's probabilities
   over all patterns, gives the final probability; candidates at 0.5 or more that meet no base span are added.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import batches, doc_texts, mapped, rows_of, stage
from passagemill.session import bounded_rows

#: Order of kinds at one start.
KINDS = ("email", "ip", "card", "phone", "secret")
VOTED = ("email", "card", "phone", "secret")
LABELERS, SHAPE_BITS = 6, 4
#: Kind, three votes for each labeler, shape bits.
PATTERNS = len(KINDS) * 3**LABELERS * 2**SHAPE_BITS
THRESHOLD = 0.5
_AROUND = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Starting inside a run of digits can match only where starting at its first digit does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_LOOSE_NUMBER = re.compile(r"(?<![\w.@])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![\w@])")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
_SPELLED = re.compile(r"(?<!\w)\w[\w.]{0,40}\x20?[\[(]at[\])]\x20?\w[\w-]{0,40}(?:\x20?[\[(.]+(?:dot[\])])?\x20?\w{2,20}){1,3}", re.IGNORECASE)

#: Words that announce a kind, in the languages of the corpus.
CONTEXT = {
    "email": ("mail", "contact", "correo", "kontakt", "courriel"),
    "card": ("card", "visa", "credit", "carte", "karte", "tarjeta", "konto"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "handy", "appel", "llam"),
    "secret": ("token", "key", "secret", "password", "passwd", "auth", "credential"),
}
#: First digits of card issuers; calling codes of one and two digits; starts of well-known keys.
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[0-9]|6[0245]")
CALLING = re.compile(r"1|7|2[07]|3[0-9]|4[0-9]|5[0-9]|6[0-9]|8[0-9]|9[0-8]")
KEY_STARTS = ("sk_", "pk_", "AKIA", "ghp_", "xox", "eyJ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@``: its run of local characters, its domain."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        else:
            done = at + 1
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans, by start, then kind."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _only_digits(m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_only_digits(m[0])) <= 15]
    return sorted(found, key=_place)


def _place(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Further candidates, perhaps overlapping base spans."""
    found: list[tuple[str, int, int]] = []
    if _DIGIT.search(text):
        for m in _LOOSE_NUMBER.finditer(text):
            n = len(_only_digits(m[0]))
            found.append(("card" if n >= 12 and m[0][0] not in "+(" else "phone", *m.span()))
        for m in _TOKEN.finditer(text):  # whole runs: the labelers decide on long ones
            if _DIGIT.search(m[0]) and any(c.isalpha() for c in m[0]):
                found.append(("secret", *m.span()))
    if "at" in text or "AT" in text:
        found += [("email", *m.span()) for m in _SPELLED.finditer(text)] if "(at)" in text.lower() or "[at]" in text.lower() else []
    return found


def _entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def votes_of(text: str, kind: str, start: int, end: int, base: bool) -> tuple[tuple[int, ...], int]:
    """Six votes (1 yes, -1 no, 0 nothing) and four shape bits of a candidate."""
    span = text[start:end]
    before = text[max(0, start - _AROUND) : start].lower()
    after = text[end : end + 8]
    digits = _only_digits(span)
    context = 1 if any(w in before for w in CONTEXT[kind]) else 0
    lead = before.rstrip()[-1:]
    if kind == "card":
        votes = (
            1 if base else 0,
            1 if luhn(digits) else -1,
            1 if ISSUERS.match(digits) else -1,
            context,
            1 if re.fullmatch(r"[0-9]{13,16}|[0-9]{4}(?:([\x20-])[0-9]{4}){3}", span) else -1,
            -1 if lead in ("=", "#", "$") or len(set(digits)) < 4 else 0,
        )
    elif kind == "phone":
        votes = (
            1 if base else 0,
            1 if span[0] == "+" and CALLING.match(digits) else 0,
            1 if 10 <= len(digits) <= 13 else -1,
            context,
            1 if re.search(r"[0-9][\x20)-]{1,2}[0-9(]", span) else -1,
            -1 if lead in ("=", "#", "$") or len(set(digits)) < 4 or re.match(r"(?:19|20)[0-9]{2}[-. ]", span) else 0,
        )
    elif kind == "secret":
        letters = len(span) - len(digits)
        votes = (
            1 if re.fullmatch(r"[0-9a-fA-F]{32,}|(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_+/=]{24,}", span) else -1,
            1 if _entropy(span) > 3.2 else -1,
            1 if span.startswith(KEY_STARTS) else 0,
            context,
            1 if lead in ("=", ":", '"', "'") else -1,
            -1 if letters > 4 * len(digits) else 0,
        )
    else:
        votes = (
            1 if base else 0,
            1 if re.search(r"\.[A-Za-z]{2,6}$", span) else -1,
            1 if re.search(r"(?:com|org|net|edu|de|fr|es|uk)$", span, re.IGNORECASE) else 0,
            context,
            1 if base or re.search(r"[\[(](?:at|dot)[\])]", span, re.IGNORECASE) else -1,
            -1 if len(span) > 60 else 0,
        )
    shape = (len(span) > 16) | (any(c in " ().-" for c in span) << 1) | ((after[:1].isalnum()) << 2) | ((lead in ("=", ":", '"')) << 3)
    return votes, int(shape)


def pattern_of(kind: str, votes: tuple[int, ...], shape: int) -> int:
    code = KINDS.index(kind)
    for v in votes:
        code = code * 3 + v + 1
    return code << SHAPE_BITS | shape


def votes_in(pattern: int) -> tuple[int, list[int], int]:
    code, shape, votes = pattern >> SHAPE_BITS, pattern & (1 << SHAPE_BITS) - 1, []
    for _ in range(LABELERS):
        votes.append(code % 3 - 1)
        code //= 3
    return code, votes[::-1], shape


def candidates_of(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind index, start, end, base, pattern) of all candidates by place; an ip has no votes (pattern -1)."""
    base = base_spans(text)
    known = set(base)
    out = [(kind, a, b, True) for kind, a, b in base] + [(kind, a, b, False) for kind, a, b in loose_spans(text) if (kind, a, b) not in known]
    out.sort(key=lambda c: (_place(c[:3]), not c[3]))
    return [(KINDS.index(k), a, b, own, pattern_of(k, *votes_of(text, k, a, b, own)) if k in VOTED else -1) for k, a, b, own in out]


_CANDIDATES = pa.schema([
    ("doc_id", pa.int64()),
    ("found", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32())]))),
])
_CANDIDATES_DDL = "doc_id long, found array<struct<kind:int,start:int,end:int,base:boolean,pattern:int>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and the candidates of every row; row-local."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "base", "pattern")
        rows = ((doc_id, [dict(zip(names, c)) for c in candidates_of(text)]) for doc_id, text in rows_of(frames))
        yield from batches(rows, _CANDIDATES)

    return doc_texts(docs).mapInArrow(run, _CANDIDATES_DDL)


@dataclass
class LabelModel:
    """P(vote | true), P(vote | false) by labeler and vote; the share of true candidates; by kind."""

    prior: dict[int, float]
    given: dict[int, np.ndarray]

    def probability(self, kind: int, votes: np.ndarray) -> np.ndarray:
        """Of rows of votes, the probability of being true."""
        logs = np.log(self.given[kind])
        score = np.array([math.log(1 - self.prior[kind]), math.log(self.prior[kind])])[None, :].repeat(len(votes), 0)
        for i in range(LABELERS):
            score += logs[i, :, votes[:, i] + 1]
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))


def fit_label_model(patterns: dict[int, int], rounds: int = 100) -> LabelModel:
    """EM on pattern counts, one model a kind, started from the majority of votes; counts are smoothed by one."""
    model = LabelModel({}, {})
    decoded = {p: votes_in(p) for p in sorted(patterns)}
    for kind in sorted({k for k, _, _ in decoded.values()}):
        merged: Counter = Counter()
        for p, (k, votes, _) in decoded.items():
            if k == kind:
                merged[tuple(votes)] += patterns[p]
        votes, counts = np.array(sorted(merged)), np.array([merged[v] for v in sorted(merged)], float)
        truth = 1 / (1 + np.exp(-votes.sum(axis=1).astype(float)))
        for _ in range(rounds):
            true, false = counts * truth, counts * (1 - truth)
            given = np.empty((LABELERS, 2, 3))
            for i in range(LABELERS):
                for v in range(3):
                    chosen = votes[:, i] == v - 1
                    given[i, 1, v], given[i, 0, v] = true[chosen].sum() + 1, false[chosen].sum() + 1
            given /= given.sum(axis=2, keepdims=True)
            model.given[kind] = given
            model.prior[kind] = float((true.sum() + 1) / (counts.sum() + 2))
            before, truth = truth, model.probability(kind, votes)
            if np.abs(truth - before).max() < 1e-9:
                break
        if (given[:, 1, 2] - given[:, 0, 2]).sum() < 0:  # the classes have changed names
            model.given[kind], model.prior[kind] = given[:, ::-1].copy(), 1 - model.prior[kind]
    return model


def _features(pattern: int) -> np.ndarray:
    kind, votes, shape = votes_in(pattern)
    own = [1.0] + [float(v == 1) for v in votes] + [float(v == -1) for v in votes] + [float(shape >> b & 1) for b in range(SHAPE_BITS)]
    row = np.zeros(len(KINDS) * len(own))
    row[kind * len(own) : (kind + 1) * len(own)] = own
    return row


def fit_classifier(patterns: dict[int, int], model: LabelModel, rounds: int = 50, penalty: float = 1.0) -> dict[int, float]:
    """Probability of each pattern: logistic regression (Newton steps) on the label model's soft labels, weighted by counts."""
    if not patterns:
        return {}
    codes = sorted(patterns)
    x = np.stack([_features(p) for p in codes])
    weight = np.array([patterns[p] for p in codes], float)
    target = np.array([model.probability(k, np.array([v]))[0] for k, v, _ in map(votes_in, codes)])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - penalty * beta
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(len(beta))
        step = np.linalg.solve(curve, gradient)
        beta += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    final = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return dict(zip(codes, final.tolist()))


def learn(found: DataFrame) -> dict[int, float]:
    """The classifier's probability of every pattern that occurs in the candidates of the whole corpus."""
    each = found.select(F.explode("found.pattern").alias("pattern")).where("pattern >= 0").groupBy("pattern").count()
    patterns = {r["pattern"]: r["count"] for r in bounded_rows(each, PATTERNS, "vote patterns")}
    return fit_classifier(patterns, fit_label_model(patterns))


def decide(found: list[dict], probability: dict[int, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans: base ones and the likely others that overlap nothing kept."""
    base = [(KINDS[c["kind"]], c["start"], c["end"]) for c in found if c["base"]]
    ordered = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in ordered], list(accumulate((b for _, b in ordered), max))
    kept, done = list(base), 0  # candidates come by start: an added one reaches to ``done``
    for c in found:
        if c["base"] or c["start"] < done or probability.get(c["pattern"], 0.0) < THRESHOLD:
            continue
        before = bisect_left(starts, c["end"])
        if not before or reach[before - 1] <= c["start"]:
            kept.append((KINDS[c["kind"]], c["start"], c["end"]))
            done = c["end"]
    return base, sorted(kept, key=_place)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()),
    ("base_sha256", pa.string()), ("spans", pa.string()),
])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every row.

    Null or empty texts have no spans; equal texts have equal spans; repeated rows stay; an empty table trains
    nothing and gives no rows. Whole texts are read once: candidates are staged, the model is fitted on their
    pattern counts, and the staged rows are decided.
    """
    found = stage(candidates(docs), "candidates")
    probability = learn(found)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, items in rows_of(frames):
                base, spans = decide(items, probability)
                n = Counter(k for k, _, _ in base)
                yield doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        yield from batches(rows(), _RESULT)

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, the spans in ``text`` replaced by ``[KIND]`` and ``n_chars`` (if there) counted anew.

    A null text stays null. The model is fitted on all rows of ``docs`` first; texts are read twice and never shuffled.
    """
    learned = learn(stage(candidates(docs), "candidates"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            at = frame.schema.get_field_index("text")
            for low in range(0, frame.num_rows, 256):
                piece = frame.slice(low, 256)
                texts = [None if t is None else _redacted(t, learned) for t in piece.column(at).to_pylist()]
                yield piece.set_column(at, frame.schema.field(at), pa.array(texts, frame.schema.field(at).type))

    out = mapped(docs, run)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _redacted(text: str, probability: dict[int, float]) -> str:
    names = ("kind", "start", "end", "base", "pattern")
    _, spans = decide([dict(zip(names, c)) for c in candidates_of(text)], probability)
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]
