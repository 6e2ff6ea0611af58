"""The chunk table on disk: Parquet, partitioned by a hash of the file path.

All chunks of a file lie in one bucket, so an incremental run rewrites only the buckets of changed
files; a hash spreads the files evenly whatever their folders look like.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.operators.search import knn
from passagemill.session import bounded_rows, new_work_path, remove, small, stage

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("symbol_type", T.StringType()),
        T.StructField("symbol_name", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
FILE_SCHEMA = T.StructType([T.StructField("filepath", T.StringType()), T.StructField("mtime", T.DoubleType())])
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("last_updated", T.StringType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("chunk_count", T.LongType()),
        T.StructField("embedding_backend", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding_dimensions", T.IntegerType()),
        T.StructField("version", T.StringType()),
        T.StructField("checksum", T.StringType()),
        T.StructField(
            "chunking_stats",
            T.StructType(
                [
                    T.StructField("structure_chunked", T.LongType()),
                    T.StructField("line_chunked", T.LongType()),
                    T.StructField("fallbacks", T.LongType()),
                ]
            ),
        ),
    ]
)
LAYOUT_SCHEMA = T.StructType([T.StructField("buckets", T.IntegerType())])

# A new table gets a power of two of buckets, so that one holds up to about this many chunks.
ROWS_PER_BUCKET = 1_000_000
LEAST_BUCKETS = 16


def buckets_for(rows: int) -> int:
    buckets = LEAST_BUCKETS
    while buckets * ROWS_PER_BUCKET < rows:
        buckets *= 2
    return buckets


def bucket_of(filepath: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(filepath), F.lit(buckets)).cast("int")


def lookup(chunks: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Rows by id, all ids in one pass."""
    if isinstance(ids, list):
        return chunks.filter(F.col("id").isin(ids))
    return chunks.join(ids.select("id"), "id", "left_semi")


def read_json_record(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON record; a missing or unreadable one gives no row."""
    try:
        read = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
        read.isEmpty()
        return read
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_many_json(spark: SparkSession, pattern: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """The same JSON file of every matching folder, with its path as ``source``; bad ones are skipped.

    With ``multi_line`` a file is one record, else every line is.
    """
    read = (
        spark.read.schema(schema)
        .option("mode", "DROPMALFORMED")
        .option("multiLine", multi_line)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
    )
    try:
        return read.json(pattern).select("*", F.col("_metadata.file_path").alias("source"))
    except AnalysisException:
        return spark.createDataFrame([], schema).withColumn("source", F.lit(None).cast("string"))


def nearest(store: ChunkStore, query_vec, k: int, keep=None) -> DataFrame:
    """``search.knn`` over a store, reading the wide columns of the k chosen rows only.

    The first pass scans ids and vectors, and the paths and languages that ``keep`` filters by. The second reads at most k buckets, chosen by partition
    pruning, and picks the rows by id.
    """
    columns = ["id", "bucket", "embedding", *(["filepath", "language"] if keep else [])]
    narrow = store.bucketed().select(*columns)
    head = bounded_rows(knn(narrow, query_vec, k, keep).select("id", "distance", "bucket"), k, "nearest rows")
    chosen = store.spark.createDataFrame([(r["id"], r["distance"]) for r in head], "id string, distance double")
    wide = store.bucketed().filter(
        F.col("bucket").isin(sorted({r["bucket"] for r in head})) & F.col("id").isin([r["id"] for r in head])
    )
    return wide.drop("bucket").join(small(chosen, k), "id")


class ChunkStore:
    """Chunk table, file times and index record under one folder.

    The number of buckets is fixed when the whole table is written, given or fitted to its rows, and
    kept beside it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.wanted_buckets = spark, path.rstrip("/"), buckets
        self.layout_path = f"{self.path}/layout"
        self.chunks_path = f"{self.path}/chunks"
        self.files_path = f"{self.path}/file_metadata"
        self.record_path = f"{self.path}/index_record"

    # ------------------------------------------------------------- state

    def exists(self) -> bool:
        return self._has(self.chunks_path)

    def has_files(self) -> bool:
        return self._has(self.files_path)

    def _has(self, path: str) -> bool:
        hadoop = self._hadoop_path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def _hadoop_path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def load_chunks(self) -> DataFrame:
        return self.bucketed().drop("bucket")

    def bucketed(self) -> DataFrame:
        schema = T.StructType(CHUNK_SCHEMA.fields + [T.StructField("bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.chunks_path)

    def load_files(self) -> DataFrame:
        if not self.has_files():
            return self.spark.createDataFrame([], FILE_SCHEMA)
        return self.spark.read.schema(FILE_SCHEMA).parquet(self.files_path)

    def load_record(self) -> DataFrame:
        return read_json_record(self.spark, self.record_path, RECORD_SCHEMA)

    def count_rows(self) -> int:
        return self.load_chunks().count()

    @property
    def buckets(self) -> int:
        layout = read_json_record(self.spark, self.layout_path, LAYOUT_SCHEMA).first()
        if layout is None:
            raise ValueError(f"no chunk table under {self.path}")
        return layout["buckets"]

    # ------------------------------------------------------------- writes

    def _placed(self, chunks: DataFrame, buckets: int) -> DataFrame:
        fitted = chunks.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA])
        bucketed = fitted.withColumn("bucket", bucket_of(F.col("filepath"), buckets))
        # a bucket may outgrow one task: AQE splits oversized partitions of this rebalance;
        # rows lie by id, so that a look-up by id skips most row groups
        return bucketed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "id")

    def write_chunks(self, chunks: DataFrame) -> None:
        """Replace the whole table. Without a given number of buckets the rows are staged and counted first."""
        if not self.wanted_buckets:
            staged = new_work_path(self.spark, "chunks")
            chunks.write.parquet(staged)  # an embedder behind these rows is asked once
            chunks = self.spark.read.schema(chunks.schema).parquet(staged)
        buckets = self.wanted_buckets or buckets_for(chunks.count())
        layout = self.spark.createDataFrame([(buckets,)], LAYOUT_SCHEMA)
        layout.coalesce(1).write.mode("overwrite").json(self.layout_path)
        self._placed(chunks, buckets).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            "bucket"
        ).parquet(self.chunks_path)
        if not self.wanted_buckets:
            self._delete(staged)

    def append_chunks(self, chunks: DataFrame) -> None:
        self._placed(chunks, self.buckets).write.mode("append").partitionBy("bucket").parquet(self.chunks_path)

    def replace_files(self, filepaths: DataFrame, new_chunks: DataFrame) -> None:
        """Drop all chunks of ``filepaths`` and add ``new_chunks``, rewriting only their buckets.

        The new chunks are staged first, so that an embedder behind them is asked once, and then the new
        content of those buckets: a table must not be overwritten while it is being read. Both are deleted
        in the end.
        """
        buckets = self.buckets
        staged = new_work_path(self.spark, "chunks")
        fitted = new_chunks.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK_SCHEMA])
        fitted.write.parquet(f"{staged}/new")
        new_chunks = self.spark.read.schema(CHUNK_SCHEMA).parquet(f"{staged}/new")
        place = bucket_of(F.col("filepath"), buckets).alias("bucket")
        gone = filepaths.select("filepath").distinct()
        touched = gone.unionByName(new_chunks.select("filepath")).select(place).distinct()
        hit = [r["bucket"] for r in bounded_rows(touched, buckets, "buckets")]
        if not hit:
            self._delete(staged)
            return
        kept = self.bucketed().filter(F.col("bucket").isin(hit)).join(gone, "filepath", "left_anti").drop("bucket")
        kept.select(*CHUNK_SCHEMA.names).unionByName(new_chunks.select(*CHUNK_SCHEMA.names)).write.parquet(f"{staged}/merged")
        merged = self.spark.read.schema(CHUNK_SCHEMA).parquet(f"{staged}/merged")
        self._placed(merged, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket"
        ).parquet(self.chunks_path)
        left = {r["bucket"] for r in bounded_rows(merged.select(place).distinct(), buckets, "buckets")}
        for bucket in sorted(set(hit) - left):  # dynamic overwrite leaves a bucket alone that got no rows
            self._delete(f"{self.chunks_path}/bucket={bucket}")
        self._delete(staged)

    def delete_by_key(self, filepaths: DataFrame) -> None:
        self.replace_files(filepaths, self.spark.createDataFrame([], CHUNK_SCHEMA))

    def write_files(self, files: DataFrame) -> None:
        fitted = files.select("filepath", F.col("mtime").cast("double").alias("mtime"))
        stage(fitted, "files").write.mode("overwrite").parquet(self.files_path)

    def write_record(self, record: DataFrame) -> None:
        """One-row JSON record."""
        fitted = record.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD_SCHEMA])
        fitted.limit(1).coalesce(1).write.mode("overwrite").json(self.record_path)

    def clear(self) -> None:
        """Remove table, file times, record, clusters and unfinished stages."""
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        remove(self.spark, path)
