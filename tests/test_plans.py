"""Physical plans that must stay as they are for large tables."""

import pytest
from pyspark.sql import functions as F

from passagemill.operators import changes, chunking, clustering, grep, notes, search, symbols
from passagemill.operators.embedding import HashEmbedder, embed
from passagemill.session import bounded_rows, small, spread
from passagemill.sources.store import ChunkStore


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    """The documents as a table of many files, and their embedded chunks."""
    path = str(tmp_path_factory.mktemp("plans"))
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    documents.select(
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("filepath"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        F.col("n_chars").cast("double").alias("mtime"),
    ).repartition(12).write.parquet(f"{path}/files")
    files = spark.read.parquet(f"{path}/files")
    embed(chunking.chunk_by_lines(files, 10, 2), "content", HashEmbedder()).write.parquet(f"{path}/chunks")
    return files, spark.read.parquet(f"{path}/chunks")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def reads(df) -> str:
    return plan(df).split("ReadSchema: ")[1].splitlines()[0]


@pytest.mark.parametrize(
    "build",
    [
        lambda f: chunking.chunk_by_lines(f, 10, 2),
        lambda f: chunking.chunk_by_structure(f, chunking.OUTLINES["python"]),
        lambda f: chunking.chunk_files(f),
        lambda f: symbols.extract_symbols(f),
        lambda f: embed(f, "content", HashEmbedder()),
        lambda f: grep.grep(f, r"\bthe\b", 1, 1),
        lambda f: symbols.find_occurrences(f, f.sparkSession.createDataFrame([("that",)], "name string")),
    ],
)
def test_row_local_operators_do_not_shuffle(stored, build):
    assert "Exchange" not in plan(build(stored[0]))


def test_nearest_rows_is_a_scan_with_a_top_k(stored):
    found = search.knn(stored[1].select("id", "embedding"), [0.0] * 64, 5)
    assert "TakeOrderedAndProject" in plan(found) and "Exchange" not in plan(found)
    assert reads(found) == "struct<id:string,embedding:array<float>>"


def test_prefilter_reaches_the_scan(stored):
    found = search.hybrid_search(stored[1], "x", [0.0] * 64, languages=["en"], path_glob="src1/**")
    assert "rlike" in plan(found).split("ArrowEvalPython")[1].lower()


def test_id_filter_is_pushed_down(stored):
    assert "In(id" in plan(stored[1].filter(F.col("id").isin(["a", "b", "c"]))).split("PushedFilters")[1]


def test_statistics_read_only_their_columns(stored):
    assert reads(changes.language_stats(stored[1])) == "struct<filepath:string,language:string>"


def test_ranks_are_cut_before_the_shuffle(stored):
    members = stored[1].withColumn("cluster_id", F.size("embedding") % 3)
    text = plan(clustering.cluster_keywords(members))
    below = text.split("WindowGroupLimit")
    assert len(below) == 3 and "Exchange" in below[1]


def test_counts_are_combined_before_the_shuffle(stored):
    text = plan(notes.latest(stored[0].select(F.col("filepath").alias("name"), "content", F.col("mtime").alias("modified_at"))))
    assert "partial_max" in text


def test_labels_scan_the_members_once(spark, stored):
    members = stored[1].withColumn("cluster_id", F.size("embedding") % 3).select("cluster_id", "filepath", "symbol_type")
    frame = clustering.cluster_labels(members)
    frame.collect()
    assert plan(frame).split("Initial Plan")[0].count("FileScan") == 1


def test_incremental_run_prunes_buckets(spark, stored, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), buckets=16)
    store.write_chunks(stored[1])
    text = plan(store.bucketed().filter(F.col("bucket").isin([1, 2])))
    assert "PartitionFilters: [isnotnull(bucket" in text or "bucket#" in text.split("PartitionFilters: ")[1].split("]")[0]


def test_bounds(spark, stored):
    with pytest.raises(ValueError, match="more than 3 rows"):
        bounded_rows(spark.range(10), 3, "numbers")
    assert "broadcast" in small(spark.range(3), 3)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(spark.range(3), 10**6)._jdf.queryExecution().logical().toString().lower()


def test_only_badly_split_tables_are_spread(spark, stored):
    many = spark.range(100, numPartitions=32)
    assert "Exchange" not in plan(spread(many, "id"))
    assert "Exchange" in plan(spread(stored[0].coalesce(1), "filepath"))
