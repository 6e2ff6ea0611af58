"""Language-model scoring by context-tree weighting over bytes.

A text is coded as its lower-cased words byte by byte, each closed by an end symbol; one more end symbol closes
the text. A symbol is nine binary decisions, each with its own tree of contexts: the ``DEPTH`` symbols before
it. Every node of a tree has counts (n0, n1) of the training texts and the Krichevsky-Trofimov probability P_e
of such counts; a node's weighted probability is P_e / 2 + (product over its children) / 2, P_e alone at full
depth. A decision is then predicted by the mixture of the estimates along its path, each node weighted by how
well it coded the training texts against its children: all depths mixed, none chosen.

The probability of a symbol is a function of its gram (the context and the symbol). So texts are dealt into
blocks, one a task; each block sends its distinct words and grams once; counts and scores are joined to them,
and they go back to the block, where its texts are scored one at a time. The trees are built from gram counts,
sharded by the last two symbols of the context; depths zero and one, at most 132,000 nodes, are shared by all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import batches, doc_texts, grow, rows_of, shuffle_width, stage

DEPTH = 5
SYMBOL_BITS = 9
END, START = 256, 257
_MASK = (1 << SYMBOL_BITS) - 1
#: A block of texts is worked on by one task; so many shuffle partitions make one block.
PARTITIONS_PER_BLOCK = 4
_TOP = 1 << 2 * SYMBOL_BITS
_LOG2 = np.log(2.0)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, eight steps up."""
    product = np.ones_like(x)
    for k in range(8):
        product = product * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


_HALF = float(log_gamma(np.array([0.5]))[0])


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones; many counts repeat, so each is worked out once."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - 2 * _HALF - log_gamma(n0 + n1 + 1.0)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # on bytes, both touch ASCII only


def grams_of(words: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """The grams (``depth`` symbols and the one they precede, nine bits each) that end at each symbol of a text."""
    raw = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)  # no word holds a space
    symbols = np.full(depth + len(raw) + 1, END, np.int64)
    symbols[:depth] = START
    symbols[depth:-1] = np.where(raw == 32, np.int64(END), raw.astype(np.int64))
    grams = symbols[: len(raw) + 1].copy()
    for k in range(1, depth + 1):
        grams <<= SYMBOL_BITS
        grams |= symbols[k : k + len(grams)]
    return grams


class Counts:
    """Distinct numbers and how often they came; memory follows the distinct ones."""

    def __init__(self):
        self.keys, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, values: np.ndarray) -> None:
        self.held.append(values)
        self.size += len(values)
        if self.size > 1 << 22:
            self.settle()

    def settle(self) -> None:
        if self.held:
            keys, n = np.unique(np.concatenate(self.held), return_counts=True)
            self.held, self.size = [], 0
            new = np.ones(len(keys), bool)
            at = np.searchsorted(self.keys, keys)
            inside = at < len(self.keys)
            new[inside] = self.keys[at[inside]] != keys[inside]
            self.n[at[~new]] += n[~new]
            self.keys, self.n = (np.insert(x, at[new], y[new]) for x, y in ((self.keys, keys), (self.n, n)))


class Lookup:
    """Values by number: an open hash table in two arrays; every number asked for is there."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, values.dtype)
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] == -1
            self.keys[place[free]] = keys[free]
            won = self.keys[place] == keys
            self.values[place[won]] = values[won]
            keys, values, place = keys[~won], values[~won], (place[~won] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self._MIX) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        off = np.flatnonzero(self.keys[place] != keys)
        while len(off):
            place[off] = (place[off] + 1) & self.mask
            off = off[self.keys[place[off]] != keys[off]]
        return self.values[place]


class Tree:
    """The nodes below one two-symbol context (depth two and more), from its grams and their training counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        context, symbol = grams >> SYMBOL_BITS, grams & _MASK
        steps = np.arange(SYMBOL_BITS)[:, None]
        nodes = (1 << steps) | (symbol >> (SYMBOL_BITS - steps))
        self.bits = (symbol >> (SYMBOL_BITS - 1 - steps)) & 1
        keys, at = np.unique((context << SYMBOL_BITS) | nodes, return_inverse=True)
        self.at = at.reshape(self.bits.shape)
        weight = np.broadcast_to(counts.astype(float), self.bits.shape).ravel()
        n1 = np.bincount(self.at.ravel(), weight * self.bits.ravel(), len(keys))
        n0 = np.bincount(self.at.ravel(), weight, len(keys)) - n1
        self.keys, self.deepest = keys, (n1 + 0.5) / (n0 + n1 + 1)
        weighted = log_kt(n0, n1)
        self.levels = []  # from deep to shallow: place of each deepest node, own weight, own estimate
        place = np.arange(len(keys))
        for d in range(depth - 1, 1, -1):
            above = ((keys >> SYMBOL_BITS) & ((1 << SYMBOL_BITS * d) - 1)) << SYMBOL_BITS | (keys & _MASK)
            keys, up = np.unique(above, return_inverse=True)
            n0, n1, children = (np.bincount(up, x, len(keys)) for x in (n0, n1, weighted))
            own = log_kt(n0, n1)
            weighted = np.logaddexp(own, children) - _LOG2
            place = up[place]
            self.levels.append((place, np.exp(own - _LOG2 - weighted), (n1 + 0.5) / (n0 + n1 + 1)))
        self.shallow = (keys, n0, n1, weighted)

    def log10_probabilities(self, top: np.ndarray) -> np.ndarray:
        """Of each gram; ``top`` has weight and estimate of the nodes of depth one (context, node) and zero (START, node)."""
        p = self.deepest
        for place, weight, estimate in self.levels:
            p = weight[place] * estimate[place] + (1 - weight[place]) * p
        node = self.keys & _MASK
        for context in ((self.keys >> SYMBOL_BITS) & _MASK, np.full(len(node), _MASK)):
            weight, estimate = top[:, context << SYMBOL_BITS | node]
            p = weight * estimate + (1 - weight) * p
        one = p[self.at]
        return np.log10(np.where(self.bits == 1, one, 1 - one)).sum(axis=0)


def _trees(frames: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, Tree]]:
    """Of rows (shard, gram, n) sorted by shard, each shard's grams and tree."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    shard = None

    def made():
        grams, counts = (np.concatenate(x) for x in zip(*held))
        return grams, Tree(grams, counts, depth)

    for frame in frames:
        shards, grams, counts = (c.to_numpy() for c in frame.columns)
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                if held and shards[a] != shard:
                    yield made()
                    held = []
                shard = shards[a]
                held.append((grams[a:b], counts[a:b]))
    if held:
        yield made()


def _top(nodes: DataFrame) -> np.ndarray:
    """Weight and estimate by context and node, of depth one, and of depth zero as the context of all ones."""
    rows = nodes.groupBy("context", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "weighted")]).toArrow()  # at most 258 x 511
    context, node, n0, n1, children = (c.to_numpy() for c in rows.columns)
    top = np.zeros((2, _TOP))

    def put(context, node, n0, n1, children):
        own = log_kt(n0, n1)
        weighted = np.logaddexp(own, children) - _LOG2
        top[:, context << SYMBOL_BITS | node] = np.exp(own - _LOG2 - weighted), (n1 + 0.5) / (n0 + n1 + 1)
        return weighted

    weighted = put(context, node, n0, n1, children)
    all_nodes, up = np.unique(node, return_inverse=True)
    put(np.full(len(all_nodes), _MASK), all_nodes, *(np.bincount(up, x, len(all_nodes)) for x in (n0, n1, weighted)))
    return top


def gram_scores(counts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, lp: log10 probability of the last symbol of each gram, trained on the counts ``n`` (zero: only scored)."""
    shard = F.shiftright("gram", SYMBOL_BITS).bitwiseAND(F.lit(_TOP - 1)).alias("shard")
    table = stage(counts.groupBy("gram").agg(F.sum("n").alias("n")).select(shard, "gram", "n"), "grams")
    dealt = table.repartition("shard").sortWithinPartitions("shard")

    def up(frames):
        schema = pa.schema([("context", pa.int64()), ("node", pa.int64()), ("n0", pa.float64()), ("n1", pa.float64()), ("weighted", pa.float64())])
        for _, tree in _trees(frames, depth):
            keys, n0, n1, weighted = tree.shallow
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((keys >> SYMBOL_BITS) & _MASK, keys & _MASK, n0, n1, weighted)], schema=schema)

    top = counts.sparkSession.sparkContext.broadcast(_top(dealt.mapInArrow(up, "context long, node long, n0 double, n1 double, weighted double")))

    def down(frames):
        for grams, tree in _trees(frames, depth):
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(tree.log10_probabilities(top.value))], names=["gram", "lp"])

    return dealt.mapInArrow(down, "gram long, lp double")


_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64()), ("bits_per_byte", pa.float64()),
])


def score_documents(docs: DataFrame, depth: int = DEPTH, blocks: int | None = None) -> DataFrame:
    """Scores of every row under a model of the rows whose crc32 of the doc_id as text is not 1 modulo 5.

    ``base_score`` is the add-a-half word model, ``score`` the context trees' log10 probability of words and
    end, ``bits_per_byte`` its code length per byte of the words and their separators. Null or empty texts
    have one token, the end; a null doc_id counts as training; repeated rows count as often as they occur; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = blocks or max(1, shuffle_width(spark) // PARTITIONS_PER_BLOCK)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False)).alias("held_out")
    texts = doc_texts(docs).withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int")).select("block", "doc_id", held, "text")

    def count(frames):
        train, seen, block = Counter({b"": 0}), set(), None
        grams, other = Counts(), Counts()
        for block, held_out, text in rows_of(frames):
            words = words_of(text)
            (other if held_out else grams).add(grams_of(words, depth))
            if held_out:
                seen.update(words)
            else:
                train.update(words)
                train[b""] += 1
        if block is None:
            return
        seen.difference_update(train)
        rows = ((block, w, None, n) for part in (train.items(), ((w, 0) for w in seen)) for w, n in part)
        yield from batches(rows, _COUNTED, 4096)
        grams.settle(), other.settle()
        unseen = np.setdiff1d(other.keys, grams.keys, assume_unique=True)
        for keys, n in ((grams.keys, grams.n), (unseen, np.zeros(len(unseen), np.int64))):
            for low in range(0, len(keys), 1 << 16):
                own = pa.array(keys[low : low + (1 << 16)])
                columns = [pa.array(np.full(len(own), block, np.int32)), pa.nulls(len(own), pa.binary()), own, pa.array(n[low : low + (1 << 16)])]
                yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)

    dealt = texts.select("block", "held_out", "text").repartitionById(blocks, "block")
    own = stage(dealt.mapInArrow(count, "block int, word binary, gram long, n long"), "block-counts")
    own_words, own_grams = own.where("word IS NOT NULL").select("block", "word", "n"), own.where("gram IS NOT NULL").select("block", "gram", "n")
    vocabulary = stage(own_words.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    train_tokens, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    known = own_words.select("block", "word").join(vocabulary, "word").select("block", "word", "c").mapInArrow(_pack_words, _PACKED)
    scored = own_grams.select("block", "gram").join(gram_scores(own_grams, depth), "gram").select("block", "gram", "lp").mapInArrow(_pack_grams, _PACKED)
    none = F.lit(None)
    tables = known.unionByName(scored).select("block", "part", "a", "b", none.cast("long").alias("doc_id"), none.cast("boolean").alias("held_out"))
    rows = texts.select("block", F.lit(2).alias("part"), F.col("text").cast("binary").alias("a"), none.cast("binary").alias("b"), "doc_id", "held_out")

    def score(frames):
        place: dict[bytes, int] = {}
        counts, keys, values, tables = [], [], [], None
        made = []
        for block, part, a, b, doc_id, held_out in rows_of(frames):
            if part == 0:
                own = a.split(b" ")
                place.update(zip(own, range(len(place), len(place) + len(own))))
                counts.append(np.frombuffer(b, np.int64))
            elif part == 1:
                keys.append(np.frombuffer(a, np.int64))
                values.append(np.frombuffer(b, np.float32))
            else:
                if tables is None:
                    seen = np.concatenate(counts)
                    tables = seen > 0, np.log10((seen + 0.5) / (train_tokens + 0.5 * (distinct + 1))), Lookup(np.concatenate(keys), np.concatenate(values))
                    counts, keys, values = [], [], []
                words = a.lower().split()
                model = float(tables[2][grams_of(words, depth)].sum(dtype=np.float64))
                words.append(b"")
                at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                n_bytes = sum(map(len, words)) + len(words) - 1
                made.append((doc_id, held_out, len(words), int(tables[0][at].sum()), train_tokens, float(tables[1][at].sum()), model, n_bytes, -model * np.log2(10) / max(1, n_bytes)))
                if len(made) == 512:
                    yield grow(list(zip(*made)), _SCORED)
                    made = []
        if made:
            yield grow(list(zip(*made)), _SCORED)

    dealt = tables.unionByName(rows).repartitionById(blocks, "block").sortWithinPartitions("part")
    return dealt.mapInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double",
    )


_COUNTED = pa.schema([("block", pa.int32()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])
#: Words (0) or grams (1) of a block with their counts or scores, many to a row.
_PACKED = "block int, part int, a binary, b binary"


def _packed(frames: Iterator[pa.RecordBatch], part: int, keys, values) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        if not frame.num_rows:
            continue
        blocks = frame.column(0).to_numpy()
        order = np.argsort(blocks, kind="stable")
        cuts = np.flatnonzero(np.diff(blocks[order], prepend=-1, append=-1))
        each = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        a, b = frame.columns[1:]
        columns = [
            pa.array([blocks[rows[0]] for rows in each], pa.int32()), pa.array([part] * len(each), pa.int32()),
            pa.array([keys(a.take(pa.array(rows))) for rows in each], pa.binary()), pa.array([values(b.take(pa.array(rows))) for rows in each], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "a", "b"])


def _pack_words(frames):
    return _packed(frames, 0, lambda a: b" ".join(a.to_pylist()), lambda b: b.to_numpy().tobytes())


def _pack_grams(frames):
    return _packed(frames, 1, lambda a: a.to_numpy().tobytes(), lambda b: b.to_numpy().astype(np.float32).tobytes())
