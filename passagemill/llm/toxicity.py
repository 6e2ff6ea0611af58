"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model sees the probabilities of the categories
before it. In training these are out-of-fold predictions, so that a later model meets probabilities as
unsure as those it will get for new documents. The chain runs over the categories the labels hold, low quality
and toxic. Folds go by the text, so that equal texts are in one fold and no copy predicts another.

The models are fitted on a bounded sample of the labelled rows (``MAX_LABELLED``, by hash of the id). Features
are words and word beginnings, since insults are inflected; they are picked by a chi-square test on the whole
sample, counted in Spark, the best of each family, at most ``MAX_WORDS`` a category (a bound of the model's
size, like that of the sample; the argument ``words``). Every document is scored in one pass over its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import batches, doc_texts, mapped, rows_of

CATEGORIES = ("low_quality", "toxic")
MAX_LABELLED, MAX_WORDS, MIN_DOCS, FOLDS, PENALTY = 20_000, 64, 5, 5, 0.3
BEGINNINGS = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_MEASURES = 6


def words_in(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def measures_of(text: str, words: list[str], distinct: Collection[str]) -> list[float]:
    """Numbers on the whole text: length, capitals, marks, digits, repetition, word length."""
    n = max(1, len(text))
    letters = sum(map(len, words))
    capitals = sum(map(len, _CAPITALS.findall(text)))
    digits = sum(map(len, _DIGITS.findall(text)))
    return [np.log1p(len(text)) / 10, capitals / n, 1 - letters / n, digits / n, len(distinct) / max(1, len(words)), letters / max(1, len(words)) / 10]


_CAPITALS, _DIGITS = re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"[0-9]+")


def fold_of(text: str) -> int:
    return zlib.crc32(text.encode()) % FOLDS


def stems_of(word: str, lengths=BEGINNINGS) -> list[str]:
    """The word and, marked by a star, its longer beginnings."""
    return [word, *(word[:n] + "*" for n in lengths if n < len(word))]


@dataclass
class Chain:
    """Feature stems with their columns, those of them that mark toxicity, and one weight vector a category; empty weights: a constant."""

    stems: dict[str, int] = field(default_factory=dict)
    markers: frozenset[str] = frozenset()
    weights: list[np.ndarray] = field(default_factory=list)
    constants: list[float] = field(default_factory=list)

    def features(self, texts: list[str]) -> np.ndarray:
        """One row a text: a one, the measures, how often markers occur, each stem."""
        first = 3 + _MEASURES
        x = np.zeros((len(texts), first + len(self.stems)))
        x[:, 0] = 1
        lengths = sorted({len(s) - 1 for s in self.stems if s[-1] == "*"})
        for i, text in enumerate(texts):
            words = words_in(text)
            counts = Counter(words)
            x[i, 1 : 1 + _MEASURES] = measures_of(text, words, counts.keys())
            hits = 0
            for word, n in counts.items():
                own = [s for s in stems_of(word, lengths) if s in self.stems]
                for stem in own:
                    x[i, first + self.stems[stem]] += n
                if own and not self.markers.isdisjoint(own):
                    hits += n
            x[i, first - 2 : first] = np.log1p(hits), min(5.0, 100 * hits / max(1, len(words)))
        x[:, first:] = np.log1p(x[:, first:])
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(CATEGORIES)))
        for c, w in enumerate(self.weights):
            out[:, c] = _sigmoid(np.hstack([x, _logits(out[:, :c])]) @ w) if len(w) else self.constants[c]
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logits(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, folds: np.ndarray) -> tuple[list[np.ndarray], list[float], np.ndarray]:
    """Weights and constants by category, and the out-of-fold probabilities. A category with one class is a constant."""
    weights, constants, held_out = [], [], np.zeros(y.shape)
    for c in range(y.shape[1]):
        constants.append(float((y[:, c].sum() + 0.5) / (len(y) + 1)))
        own = np.hstack([x, _logits(held_out[:, :c])])
        if len(np.unique(y[:, c])) < 2:
            weights.append(np.zeros(0))
            held_out[:, c] = constants[c]
            continue
        weights.append(fit_linear(own, y[:, c]))
        for f in np.unique(folds):
            inside, outside = folds != f, folds == f
            split = inside.any() and len(np.unique(y[inside, c])) == 2
            held_out[outside, c] = _sigmoid(own[outside] @ fit_linear(own[inside], y[inside, c])) if split else constants[c]
    return weights, constants, held_out


def _sample(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids by hash; several labels of an id: the worst of each kind; null labels count as good."""
    bad = F.max((F.coalesce(F.col("quality").cast("int"), F.lit(1)) == 0).cast("int")).alias("low_quality")
    toxic = F.max((F.coalesce(F.col("toxic").cast("int"), F.lit(0)) != 0).cast("int")).alias("toxic")
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(bad, toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _count_stems(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    by: list[Counter] = [Counter(), Counter()]
    for text, low, toxic in rows_of(frames):
        distinct = {s for w in set(words_in(text)) for s in stems_of(w)}
        total.update(distinct)
        for c, flag in enumerate((low, toxic)):
            if flag:
                by[c].update(distinct)
    schema = pa.schema([("stem", pa.string()), ("n", pa.int64()), ("n_low", pa.int64()), ("n_toxic", pa.int64())])
    yield from batches(((w, n, by[0][w], by[1][w]) for w, n in total.items()), schema)


def _best_of_families(stems: list[str], most: int) -> list[str]:
    """The first ``most`` of ranked stems, leaving out those that begin with, or are a beginning of, one taken before."""
    taken: list[str] = []
    for stem in stems:
        bare = stem.rstrip("*")
        if not any(bare.startswith(t.rstrip("*")) or t.startswith(bare) for t in taken):
            taken.append(stem)
            if len(taken) == most:
                break
    return taken


def _chi_square(n: str, hits: str, rows: int, positive: int):
    """Of the two-by-two table word x class, signed: only words that are more frequent in the class count."""
    a, b = F.col(hits).cast("double"), F.col(n).cast("double") - F.col(hits)
    c, d = positive - a, rows - positive - b
    spread = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when((spread > 0) & (a * d > b * c), (a * d - b * c) ** 2 * rows / spread).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, words: int = MAX_WORDS) -> Chain:
    """Fit the chain on documents whose id is in the sample of ``labels`` (at most ``limit`` ids, which are broadcast)."""
    spark = docs.sparkSession
    chosen = _sample(labels, limit).collect()
    known = spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, low_quality int, toxic int")
    sample = doc_texts(docs).join(F.broadcast(known), "doc_id")
    counts = sample.select("text", "low_quality", "toxic").mapInArrow(_count_stems, "stem string, n long, n_low long, n_toxic long")
    by_stem = counts.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("n", "n_low", "n_toxic")]).where(F.col("n") >= MIN_DOCS)
    rows, bad, toxic = (len(chosen), sum(r.low_quality for r in chosen), sum(r.toxic for r in chosen))
    scored = by_stem.select(
        "stem",
        _chi_square("n", "n_low", rows, bad).alias("low"),
        _chi_square("n", "n_toxic", rows, toxic).alias("toxic"),
    )
    # Ten beginnings of a family may rank before the next family.
    top = lambda c: scored.where(F.col(c) > 0).orderBy(F.desc(c), F.desc(F.length("stem")), "stem").limit(16 * words).select("stem", F.lit(c).alias("of"), F.col(c).alias("score"))
    picked = top("low").unionByName(top("toxic")).collect() if rows else []
    ranked = {c: sorted((r for r in picked if r.of == c), key=lambda r: (-r.score, -len(r.stem), r.stem)) for c in ("low", "toxic")}
    best = {c: _best_of_families([r.stem for r in ranked[c]], words) for c in ranked}
    strong = {r.stem for r in ranked["toxic"] if r.score >= 0.005 * rows and r.score >= 12}
    chain = Chain({s: i for i, s in enumerate(sorted({*best["low"], *best["toxic"]}))}, frozenset(strong & set(best["toxic"])))
    width = 3 + _MEASURES + len(chain.stems)

    def featured(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for doc_id, text, low, tox in rows_of(frames):
                x = chain.features([text])[0]
                at = np.flatnonzero(x)
                yield doc_id, low, tox, fold_of(text), at.tolist(), x[at].tolist()

        schema = pa.schema([("doc_id", pa.int64()), ("low", pa.int32()), ("toxic", pa.int32()), ("fold", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))])
        yield from batches(each(), schema, 256)

    per_id = sample.dropDuplicates(["doc_id"]) if rows else sample  # repeated rows of an id would exceed the bound
    made = per_id.select("doc_id", "text", "low_quality", "toxic").mapInArrow(featured, "doc_id long, low int, toxic int, fold int, at array<int>, x array<double>")
    got = sorted(made.collect(), key=lambda r: r.doc_id) if rows else []
    x, y = np.zeros((len(got), width)), np.zeros((len(got), len(CATEGORIES)))
    for i, r in enumerate(got):
        x[i, r["at"]] = r["x"]
        y[i] = r["low"], r["toxic"]
    folds = np.array([r["fold"] for r in got])
    chain.weights, chain.constants, _ = fit_chain(x, y, folds) if len(got) else ([np.zeros(0)] * len(CATEGORIES), [0.0] * len(CATEGORIES), None)
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, the probability of each category, and ``is_toxic``, for every row; row-local.

    Null or empty texts are scored on their measures alone, equal texts equally; repeated rows stay. Without
    labelled documents every probability is zero.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"p_{c}", pa.float64()) for c in CATEGORIES), ("is_toxic", pa.bool_())])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, 256):
                ids, texts = frame.slice(at, 256).columns
                p = chain.probabilities(chain.features(texts.to_pylist()))
                toxic = p[:, CATEGORIES.index("toxic")] >= THRESHOLD
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(p[:, c]) for c in range(len(CATEGORIES))), pa.array(toxic)], schema=schema)

    return doc_texts(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", is_toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the chain fitted on them and ``labels`` does not find toxic.

    A null text counts as empty; equal texts stay or go together, repeated rows too; ids may be null or repeat,
    for they decide nothing; a document exactly at the threshold goes. Without labelled documents all stay, and an
    empty table stays empty.
    """
    chain = train(docs, labels)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            text = frame.schema.get_field_index("text")
            for at in range(0, frame.num_rows, 256):
                piece = frame.slice(at, 256)
                texts = [t or "" for t in piece.column(text).to_pylist()]
                p = chain.probabilities(chain.features(texts))
                yield piece.filter(pa.array(p[:, CATEGORIES.index("toxic")] < THRESHOLD))

    return mapped(docs, run)
