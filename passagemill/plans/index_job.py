"""Indexing runs over a file tree: full, incremental, resumed, with automatic repair.

A run is a chain of stages (chunks, embedded chunks) written to the store's folder. A stage that
finished before a crash is read back by the next run if backend and model are the same and no file
changed since, so only the missing stages are computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.text import line_range, lines_of
from passagemill.operators import changes, clustering
from passagemill.operators.chunking import DEFAULT_MAX_LINES, DEFAULT_OVERLAP, chunk_files
from passagemill.operators.embedding import HashEmbedder, check_dimensions, embed
from passagemill.operators.search import hybrid_search, search_by_concept, search_similar
from passagemill.plans.summary import corpus_summary
from passagemill.session import small, stage
from passagemill.sources.files import DEFAULT_EXCLUDE, DEFAULT_INCLUDE, is_staged, list_tree, read_files, scan_corpus
from passagemill.sources.store import CHUNK_SCHEMA, ChunkStore, nearest, read_json_record

VERSION = "1"

# Up to this many changed files are read by name; of more, one scan keeps those that changed.
NAMED_FILES = 10_000

STAGE_SCHEMA = T.StructType(
    [
        T.StructField("phase", T.StringType()),
        T.StructField("embedding_backend", T.StringType()),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("started_at", T.StringType()),
    ]
)


@dataclass
class IndexResult:
    files_indexed: int
    chunks_created: int
    incremental: bool
    repaired: bool = False
    resumed: bool = False


class CorpusIndex:
    """The index of one file tree."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        store_path: str,
        embedder=None,
        include: Sequence[str] = DEFAULT_INCLUDE,
        exclude: Sequence[str] = DEFAULT_EXCLUDE,
        max_lines: int = DEFAULT_MAX_LINES,
        overlap: int = DEFAULT_OVERLAP,
    ):
        self.spark, self.root = spark, root
        self.store = ChunkStore(spark, store_path)
        self.embedder = embedder or HashEmbedder()
        self.include, self.exclude = include, exclude
        self.max_lines, self.overlap = max_lines, overlap
        self.stage_path = f"{self.store.path}/stage"
        self.concepts_path = f"{self.store.path}/concepts"

    # ------------------------------------------------------------- inputs

    def files(
        self, with_content: bool = True, tree: DataFrame | None = None, only: Sequence[str] | DataFrame | None = None
    ) -> DataFrame:
        return scan_corpus(self.spark, self.root, self.include, self.exclude, with_content, tree, only)

    def changes(self, tree: DataFrame | None = None) -> DataFrame:
        return changes.detect_changes(self.files(with_content=False, tree=tree), self.store.load_files())

    def staleness(self) -> DataFrame:
        if not self.store.exists():
            return self.spark.createDataFrame([(True, "nothing is indexed yet")], "stale boolean, reason string")
        if not self.store.has_files():
            return self.spark.createDataFrame([(True, "the index has no file times")], "stale boolean, reason string")
        return changes.staleness(self.changes())

    # ------------------------------------------------------------- state

    def verdict(self) -> DataFrame:
        """One row: corrupted, reason."""
        n = self.store.count_rows()
        counted = self.spark.createDataFrame([(n,)], "actual_chunks bigint")
        checksum = changes.index_checksum(self.store.load_files(), n).withColumnRenamed("checksum", "actual_checksum")
        return changes.validate_index(self.store.load_record(), counted, checksum)

    def mismatch(self) -> DataFrame:
        record = self.store.load_record()
        return check_dimensions(
            self.store.load_chunks(), record, self.embedder.name, self.embedder.model, self.embedder.dim
        )

    def status(self) -> DataFrame:
        return changes.index_status(self.store.load_chunks(), self.store.load_record(), self.verdict(), self.mismatch())

    # ------------------------------------------------------------- runs

    def index(self, force: bool = False, auto_repair: bool = False) -> IndexResult:
        """Repair if corrupt, resume if a stage is left over, full if needed, else incremental."""
        exists = self.store.exists()
        if auto_repair and exists and self.verdict().first()["corrupted"]:
            self.clear()
            return IndexResult(**{**vars(self.index(force=True)), "repaired": True})
        # listed once: its times are older than the texts read later, so a file changed in between
        # counts as modified next time
        tree = list_tree(self.spark, self.root)
        if not force:
            left_over = self._usable_stage(tree)
            if left_over is not None:
                return self._full(left_over, tree)
        self.store._delete(self.stage_path)
        if force or not exists:
            return self._full(None, tree)
        differs = self.mismatch().first()
        if differs is not None and differs["mismatch"]:
            return self._full(None, tree)
        return self._incremental(tree)

    def clear(self) -> None:
        self.store.clear()

    def _usable_stage(self, tree: DataFrame) -> str | None:
        """Last finished phase of an interrupted run, if it still fits the files and the embedder."""
        record = read_json_record(self.spark, f"{self.stage_path}/record", STAGE_SCHEMA).first()
        if record is None:
            return None
        same = (record["embedding_backend"], record["embedding_model"]) == (self.embedder.name, self.embedder.model)
        if not same:
            return None
        then = self.spark.read.parquet(f"{self.stage_path}/files")
        moved = changes.detect_changes(self.files(with_content=False, tree=tree), then).filter("change <> 'unchanged'")
        return record["phase"] if moved.isEmpty() else None

    def _mark(self, phase: str) -> None:
        row = (phase, self.embedder.name, self.embedder.model, datetime.now(UTC).isoformat())
        record = self.spark.createDataFrame([row], STAGE_SCHEMA)
        record.coalesce(1).write.mode("overwrite").json(f"{self.stage_path}/record")

    def _chunk(self, files: DataFrame) -> DataFrame:
        return chunk_files(files, self.max_lines, self.overlap)

    def _embed(self, chunks: DataFrame) -> DataFrame:
        return embed(chunks, "content", self.embedder).select(*CHUNK_SCHEMA.names)

    def _full(self, finished: str | None, tree: DataFrame) -> IndexResult:
        files_path, chunks_path, embedded_path = (f"{self.stage_path}/{x}" for x in ("files", "chunks", "embedded"))
        if finished is None:
            self.files(with_content=False, tree=tree).select("filepath", "mtime").write.mode("overwrite").parquet(files_path)
            self._chunk(self.files(tree=tree)).write.mode("overwrite").parquet(chunks_path)
            self._mark("chunking")
        chunks = self.spark.read.parquet(chunks_path)
        if finished != "embedding":
            self._embed(chunks).write.mode("overwrite").parquet(embedded_path)
            self._mark("embedding")
        self.store.write_chunks(self.spark.read.schema(CHUNK_SCHEMA).parquet(embedded_path))
        files = self.spark.read.parquet(files_path)
        self.store.write_files(files)
        per_file = chunks.select("filepath", "method", "fell_back").distinct()
        created = self._write_record(per_file)
        n_files = files.count()
        self.store._delete(self.stage_path)
        return IndexResult(n_files, created, False, resumed=finished is not None)

    def _incremental(self, tree: DataFrame) -> IndexResult:
        # staged: the run overwrites the tables this set is computed from
        changed = stage(self.changes(tree), "changes")
        if changed.filter("change <> 'unchanged'").isEmpty():
            return IndexResult(0, self.store.count_rows(), True)
        fresh = stage(self._chunk(self._changed_files(changed, tree)), "fresh")
        outdated = changed.filter(F.col("change").isin("modified", "deleted"))
        self.store.replace_files(outdated, self._embed(fresh))
        self.store.write_files(self.files(with_content=False, tree=tree).select("filepath", "mtime"))
        created = self._write_record(fresh.select("filepath", "method", "fell_back").distinct())
        n = changed.filter(F.col("change").isin("added", "modified")).count()
        return IndexResult(n, created, True)

    def _changed_files(self, changed: DataFrame, tree: DataFrame) -> DataFrame:
        """Texts of new and newer files of a listing. They are the only ones opened; where Spark listed, up to ``NAMED_FILES``."""
        names = changed.filter(F.col("change").isin("added", "modified")).select("filepath")
        if is_staged(tree):
            return self.files(tree=tree, only=names)
        some = [r["filepath"] for r in names.limit(NAMED_FILES + 1).collect()]
        if len(some) <= NAMED_FILES:
            return self.files(tree=tree, only=some)
        return self.files(tree=tree, only=names)

    def _write_record(self, per_file: DataFrame) -> int:
        n = self.store.count_rows()
        files = self.store.load_files()
        one = F.lit(1).alias("one")
        counted = files.agg(F.count(F.lit(1)).alias("file_count"), one)
        checksum = changes.index_checksum(files, n).select("checksum", one)
        tally = per_file.agg(
            F.struct(
                F.count_if(F.col("method") == "structure").alias("structure_chunked"),
                F.count_if(F.col("method") == "lines").alias("line_chunked"),
                F.count_if("fell_back").alias("fallbacks"),
            ).alias("chunking_stats"),
            one,
        )
        record = (
            counted.join(checksum, "one")
            .join(tally, "one")
            .select(
                F.lit(datetime.now(UTC).isoformat()).alias("last_updated"),
                "file_count",
                F.lit(n).alias("chunk_count"),
                F.lit(self.embedder.name).alias("embedding_backend"),
                F.lit(self.embedder.model).alias("embedding_model"),
                F.lit(self.embedder.dim).alias("embedding_dimensions"),
                F.lit(VERSION).alias("version"),
                "checksum",
                "chunking_stats",
            )
        )
        self.store.write_record(record)
        return n

    # ------------------------------------------------------------- concepts

    def concepts(self, force: bool = False, k: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
        """(assignments, clusters) of the chunks; the stored ones while the index checksum is the same.

        clusters: cluster_id, size, centroid, label, keywords, representative_ids, checksum.
        """
        record = self.store.load_record().select("checksum").first()
        checksum = record["checksum"] if record else None
        clusters_path, assigned_path = f"{self.concepts_path}/clusters", f"{self.concepts_path}/assignments"
        if not force and checksum is not None and self.store._has(clusters_path):
            stored = self.spark.read.parquet(clusters_path)
            if not stored.filter(F.col("checksum") == checksum).isEmpty():
                return self.spark.read.parquet(assigned_path), stored
        chunks = self.store.load_chunks()
        vectors = chunks.select("id", "embedding")
        assigned, centers = clustering.kmeans(vectors, k, seed=seed)
        assigned.write.mode("overwrite").parquet(assigned_path)
        assigned = self.spark.read.parquet(assigned_path)
        members = chunks.drop("embedding").join(assigned, "id")
        reps = clustering.representatives(vectors, assigned, centers)
        few = clustering.REPRESENTATIVES * centers.count()
        rep_members = chunks.drop("embedding").join(small(reps.select("id", "cluster_id"), few), "id")
        labels = clustering.cluster_labels(
            members, clustering.keyword_lists(clustering.cluster_keywords(rep_members))
        )
        ordered = F.array_sort(F.collect_list(F.struct("place", "id")))
        rep_ids = reps.groupBy("cluster_id").agg(F.transform(ordered, lambda r: r["id"]).alias("representative_ids"))
        clusters = (
            centers.join(labels, "cluster_id", "left")
            .join(clustering.keyword_lists(clustering.cluster_keywords(members)), "cluster_id", "left")
            .join(rep_ids, "cluster_id", "left")
            .withColumn("checksum", F.lit(checksum))
        )
        clusters.write.mode("overwrite").parquet(clusters_path)
        return assigned, self.spark.read.parquet(clusters_path)

    # ------------------------------------------------------------- answers

    def _vector(self, text: str) -> list[float]:
        return [float(x) for x in self.embedder([text])[0]]

    def _fresh(self, auto_reindex: bool) -> None:
        if auto_reindex and self.staleness().first()["stale"]:
            self.index()

    def search(
        self,
        query: str,
        limit: int = 10,
        path_glob: str | None = None,
        languages: Sequence[str] | None = None,
        auto_reindex: bool = True,
    ) -> DataFrame:
        """Hybrid search, after bringing the index up to date if files changed."""
        self._fresh(auto_reindex)
        return hybrid_search(self.store, query, self._vector(query), limit, path_glob, languages, scan=nearest)

    def search_similar(
        self,
        code: str | None = None,
        filepath: str | None = None,
        start_line: int | None = None,
        end_line: int | None = None,
        limit: int = 10,
        threshold: float = 0.0,
        exclude_self: bool = True,
    ) -> DataFrame:
        """Chunks like a piece of text, or like a file or a line range of it."""
        if code is None and filepath is None:
            raise ValueError("give a text or a file")
        if code is None:
            lines = lines_of(F.col("content"))
            last = F.size(lines) if end_line is None else F.lit(end_line)
            row = read_files(self.spark, self.root, [filepath]).select(line_range(lines, F.lit(start_line or 1), last)).first()
            source = row[0] if row else ""
        else:
            source = code
        if not source.strip():
            raise ValueError("the text to compare with is blank")
        # a whole file is no chunk: only a given line range can be left out as itself
        place = None if code is not None else (filepath, start_line or 0, end_line or 0)
        vector = self._vector(source)
        return search_similar(self.store, vector, place, code, limit, threshold, exclude_self, scan=nearest)

    def search_by_concept(self, concept: int, query: str | None = None, limit: int = 10) -> DataFrame:
        """Chunks of one concept: near a query, or its representatives."""
        assigned, clusters = self.concepts()
        stored = clusters.select("cluster_id", F.posexplode("representative_ids").alias("place", "id"))
        vector = None if query is None else self._vector(query)
        return search_by_concept(self.store.load_chunks(), assigned, concept, vector, limit, stored)

    def summary(self, k: int | None = None) -> DataFrame:
        """Totals, languages, concepts, keywords and quality."""
        assigned, _ = self.concepts(k=k)
        chunks = self.store.load_chunks()
        return corpus_summary(chunks, chunks.join(assigned, "id"))
