"""Session helpers: where to write intermediate tables and how to bound driver-side reads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORK_DIR_SETTING = "spark.checkpoint.dir"
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``; without that setting only a local session works, in a
    folder of its warehouse. No temporary folder of a machine is ever used.
    """
    configured = spark.conf.get(WORK_DIR_SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {WORK_DIR_SETTING} to a folder all executors can reach")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/passagemill-work"


def new_work_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings of the session for what runs in the block."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so lost executors cost no recomputation.

    Its shuffle files go with the write; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = path or new_work_path(spark, name)
    with settings(spark, {CLEANUP_SETTING: "true"}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the file system that Spark reaches ``path`` by."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Staged frames that nothing reads after a ``with`` block; their folders are deleted when it ends.

    What the block hands on must be staged outside of it (``stage``) before the block ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_work_path(self.spark, name))
        return stage(df, name, self.paths[-1])

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.clear()

    def clear(self) -> None:
        """Delete what was staged so far."""
        while self.paths:
            remove(self.spark, self.paths.pop())


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a frame that must be small; fail instead of flooding the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


BROADCAST_ROWS = 10_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a frame known to hold at most ``rows`` rows, if that is few; else leave the choice to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash a scanned table over all cores if it is stored in fewer pieces than there are cores.

    A small table may lie in one Parquet row group, which only one task can read; text work on it
    would use one core. A table with enough splits is left as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    pieces = scan.select(key)._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if pieces >= cores else scan.repartition(cores, key)
