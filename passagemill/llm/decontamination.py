"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased and cut into words at ASCII white space; shingles are runs of five words. For every
benchmark item of n shingles, windows of n shingles are laid over the documents, at every place where enough
of the window's shingles are the item's, in any order, to reach the similarity: of each window by the first
of those shingles, so a row of the document's places decides alone. Each window gets a 64-bit SimHash.
Windows and items are joined on (n, block number, block bits), 21 blocks: two
fingerprints within 20 bits agree on a block, so the join misses none of them. Each pair is then verified by
the exact similarity of the two bags of shingles, each shingle weighted by how often it occurs:
sum of minima / sum of maxima, at least 0.8.

At that similarity a SimHash differs in about 10 of 64 bits (a standard deviation of 3), so the radius of 20
loses about one pair at the very threshold in ten thousand, and fewer above it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import free_names

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 20
#: Shingles of a document that are worked on together; longer documents are cut, with overlap.
CHUNK = 4096
#: Up to so many benchmark shingles (eight bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000
_SPACE = " \t\n\x0b\x0c\r"


def _shift_right(value: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, bits)


def _shift_left(value: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", value, bits)


def word_hashes(text: Column) -> Column:
    """XXH64 of each word; a null or blank text has none."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """A hash of each run of words; fewer words: none. ``words`` must be a column, not an expression."""
    last = F.size(words) - shingle
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(shingle)]))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """A bit is set if it is set in over half of the hashes."""

    def bit(acc: Column, b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0).cast("bigint"), lambda s, h: s + _shift_right(h, b).bitwiseAND(F.lit(1).cast("bigint")))
        return F.when(ones * 2 > F.size(hashes), acc.bitwiseOR(_shift_left(F.lit(1).cast("bigint"), b))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), bit)


def similarity(a: Column, b: Column) -> Column:
    """Of two bags of hashes: sum of minima / sum of maxima of their counts."""
    count = lambda bag, s: F.size(F.filter(bag, lambda x: x == s))
    common = F.aggregate(F.array_distinct(b), F.lit(0), lambda acc, s: acc + F.least(count(a, s), count(b, s)))
    return common / (F.size(a) + F.size(b) - common)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: what a generator returns isn't copied into later expressions."""
    return df.withColumn(name, F.explode(F.array(value)))


def _masks(radius: int) -> list[int]:
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << high) - (1 << low) for low, high in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _blocks(fp: str, masks: list[int]) -> Column:
    array = F.array(*[F.lit(m).cast("bigint") for m in masks])
    return F.posexplode(F.transform(array, lambda m: F.col(fp).bitwiseAND(m))).alias("block", "bits")


def _bitmap(shingles: list[int]) -> tuple[Column, int]:
    """A set of hashes as a literal of 64-bit words, at least 32 bits for each, and the bits of an index into it."""
    index = max(10, min(22, (32 * max(1, len(shingles)) - 1).bit_length()))
    words = [0] * (1 << (index - 6))
    for h in shingles:
        at = h & (1 << index) - 1
        words[at >> 6] |= 1 << (at & 63)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    return F.from_json(F.lit(json.dumps(signed)), "array<bigint>"), index


def _maybe_in(bitmap: Column, index: int, h: Column) -> Column:
    at = h.bitwiseAND(F.lit((1 << index) - 1).cast("bigint")).cast("int")
    word = F.get(bitmap, _shift_right(at, F.lit(6)))
    return _shift_right(word, at.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("bigint")) == 1


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, shingles, n, fp of the items of at least five words; one row for repeated rows of an item."""
    words = _once(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "words", word_hashes(F.col("text")))
    shingled = _once(words, "shingles", shingle_hashes(F.col("words"))).where(F.size("shingles") > 0).select("item_id", "shingles").distinct()
    return _once(shingled.select("item_id", "shingles", F.size("shingles").alias("n")), "fp", simhash(F.col("shingles")))


def windows(docs: DataFrame, items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, n, start, window: each window that can reach the similarity once, with its shingle hashes."""
    bags = items.select(F.xxhash64("shingles").alias("bag"), "n", F.col("shingles").alias("item"), F.size(F.array_distinct("shingles")).alias("kinds")).distinct()
    offsets = bags.select("bag", "n", F.explode(F.array_distinct("item")).alias("h"))
    total, longest = offsets.agg(F.count("*"), F.max("n")).first()
    reach = longest or 1
    few = total <= BROADCAST_SHINGLES
    words = _once(docs.select("doc_id", "text"), "words", word_hashes(F.col("text"))).select("doc_id", "words")
    shingled = _once(words, "hs", shingle_hashes(F.col("words"))).where(F.size("hs") > 0).select("doc_id", "hs")

    def cut(base: Column) -> Column:
        low = F.greatest(F.lit(0), base - reach)
        return F.struct(base.alias("base"), low.alias("low"), F.slice("hs", low + 1, F.lit(CHUNK + 2 * reach)).alias("hs"))

    chunks = F.explode(F.transform(F.sequence(F.lit(0), F.size("hs") - 1, F.lit(CHUNK)), cut)).alias("chunk")
    chunk = shingled.select("doc_id", F.size("hs").alias("total"), chunks).select("doc_id", "total", "chunk.*")
    first = F.col("base") - F.col("low")
    places = F.sequence(first, F.least(first + CHUNK, F.size("hs")) - 1)
    if few:  # a set with false positives, so that few places leave the row; the join decides
        bitmap, index = _bitmap([r.h for r in offsets.select("h").distinct().collect()])
        places = F.filter(places, lambda i: _maybe_in(bitmap, index, F.get("hs", i)))
    near = F.transform(
        places,
        lambda i: F.struct(
            (i + F.col("low")).alias("pos"), F.get("hs", i).alias("h"), F.greatest(F.lit(0), i - reach).alias("from"),
            F.slice("hs", F.greatest(F.lit(0), i - reach) + 1, F.lit(2 * reach)).alias("around"),
        ),
    )
    found = chunk.select("doc_id", "total", "low", F.explode(near).alias("at")).select("doc_id", "total", "low", "at.*")
    near_by = F.broadcast if few else (lambda df: df)
    lined = found.join(near_by(offsets), "h").join(near_by(bags.drop("n")), "bag")
    at, size = F.col("pos") - F.col("low") - F.col("from"), F.least("n", "total")
    enough = F.ceil(F.lit(least) * (F.col("size") + F.col("n")) / (1 + least) - 1e-9).cast("int")
    sized = lined.withColumn("size", size).withColumn("at", at).withColumn("need", enough)
    ahead = F.slice("around", F.col("at") + 1, F.col("size"))
    sized = sized.where(F.size(F.array_intersect(ahead, F.col("item"))) + F.col("n") - F.col("kinds") >= F.col("need"))
    held = F.filter(F.sequence(F.lit(0), F.size("around") - 1), lambda i: F.array_contains("item", F.get("around", i)))
    placed = _once(sized, "held", held)  # where around this place the item's shingles are
    before = F.coalesce(F.array_max(F.filter("held", lambda i: i < F.col("at"))), F.lit(-1))
    last = F.get(F.filter("held", lambda i: i >= F.col("at")), F.col("need") - 1)  # none: too few
    begin = F.col("low") + F.col("from")
    low = begin + F.greatest(F.lit(0), before + 1, last - F.col("size") + 1)
    high = F.least(F.col("pos"), F.col("total") - F.col("size"))
    spans = placed.where(last.isNotNull()).withColumn("lowest", low).withColumn("highest", high).where("lowest <= highest")
    starts = spans.withColumn("start", F.explode(F.sequence("lowest", "highest")))
    inside = F.slice("around", F.col("start") - begin + 1, F.col("size")).alias("window")
    return starts.select("doc_id", "n", "start", inside).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start: the best window of each document for each item it holds.

    ``start`` is the window's first word, the lowest of equally similar windows. A document shorter than an item is
    compared as a whole. Null and empty texts, and texts and items of fewer than five words, match nothing;
    repeated documents or items give one row for each pair of ids; a null doc_id is an id like any other.
    """
    return _held(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, least, radius)


def _held(docs: DataFrame, benchmark: DataFrame, least: float, radius: int) -> DataFrame:
    """As ``contaminated``, with a doc_id of any type."""
    items = items_of(benchmark)
    masks = _masks(radius)
    marked = _once(windows(docs, items, least), "fp", simhash(F.col("window")))
    left = marked.select("doc_id", "n", "start", "window", "fp", _blocks("fp", masks))
    right = items.select("item_id", "n", F.col("shingles").alias("item"), F.col("fp").alias("item_fp"), _blocks("fp", masks))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    earlier = F.slice(F.array(*[F.lit(m).cast("bigint") for m in masks]), F.lit(1), F.col("block"))
    once = F.forall(earlier, lambda m: differ.bitwiseAND(m) != 0)  # a pair counts at its first equal block only
    pairs = left.join(right, ["n", "block", "bits"]).where((F.bit_count(differ) <= radius) & once)
    scored = pairs.select("doc_id", "item_id", "start", similarity(F.col("window"), F.col("item")).alias("similarity")).where(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"))).alias("best")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.start")).cast("long").alias("start"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text holds no item.

    A row is judged by its text alone, so rows that share an id, or have none, are told apart; repeated rows go or
    stay together. Null and empty texts stay. Columns may have any names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.struct(F.xxhash64(F.lit(1), text).alias("a"), F.xxhash64(F.lit(2), text).alias("b"))  # 128 bits
    (mark,) = free_names(docs, "held")
    held = _held(docs.select(digest.alias("doc_id"), "text"), benchmark, SIMILARITY, RADIUS).select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(held, digest == F.col(mark), "left_anti")


SQL = """
WITH docs AS (
    SELECT doc_id, CASE WHEN trim(t, ' \t\n\x0b\x0c\r') = '' THEN [] ELSE string_split_regex(trim(t, ' \t\n\x0b\x0c\r'), '[ \\t\\n\\x0B\\f\\r]+') END AS w
    FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
), items AS (
    SELECT item_id, CASE WHEN trim(t, ' \t\n\x0b\x0c\r') = '' THEN [] ELSE string_split_regex(trim(t, ' \t\n\x0b\x0c\r'), '[ \\t\\n\\x0B\\f\\r]+') END AS w
    FROM (SELECT DISTINCT item_id, lower(coalesce(text, '')) AS t FROM benchmark)
), ds AS (
    SELECT doc_id, len(w) - 4 AS total, i AS pos, array_to_string(w[i + 1 : i + 5], ' ') AS s
    FROM docs, unnest(range(len(w) - 4)) AS x(i) WHERE len(w) >= 5
), its AS (
    SELECT item_id, len(w) - 4 AS n, i AS pos, array_to_string(w[i + 1 : i + 5], ' ') AS s
    FROM items, unnest(range(len(w) - 4)) AS x(i) WHERE len(w) >= 5
), met_at AS (
    SELECT DISTINCT doc_id, n, total, ds.pos FROM ds JOIN its USING (s)
), win AS (  -- every window that holds a shingle of an item
    SELECT DISTINCT doc_id, n, start FROM met_at, unnest(range(greatest(0, least(pos - n + 1, total - n)), greatest(0, least(pos, total - n)) + 1)) AS x(start)
), win_bags AS (
    SELECT win.doc_id, n, start, s, count(*) AS c
    FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.pos >= start AND ds.pos < start + n
    GROUP BY ALL
), sizes AS (
    SELECT doc_id, n, start, sum(c) AS size FROM win_bags GROUP BY ALL
), item_bags AS (
    SELECT item_id, n, s, count(*) AS c FROM its GROUP BY ALL
), common AS (
    SELECT doc_id, item_id, n, start, sum(least(a.c, b.c)) AS met
    FROM win_bags a JOIN item_bags b USING (n, s) GROUP BY ALL
), scored AS (
    SELECT doc_id, item_id, start, met::DOUBLE / (size + n - met)::DOUBLE AS similarity FROM common JOIN sizes USING (doc_id, n, start)
)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(start, (-similarity, start))::BIGINT AS start
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
