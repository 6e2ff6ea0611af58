"""Running a stream into tables: to the end of its input, or for as long as it lives."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagemill.session import new_work_path, stage

# Fixed value: how long changes are gathered before they are written.
MICRO_BATCH = "1 second"


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder, as a stream of its files.

    The path is given as a pattern that matches just itself, since a plain path must be a folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def fan_out(
    stream: DataFrame,
    sinks: Mapping[str, Callable[[DataFrame, int], None]],
    checkpoint: str,
    mode: str = "append",
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Hand every micro-batch to all sinks. A sink must tolerate seeing a batch number twice.

    Several sinks read the batch from a staged table, so its state is not computed once per sink.
    """

    def deliver(batch: DataFrame, number: int) -> None:
        shared = stage(batch, "fanout") if len(sinks) > 1 else batch
        for write in sinks.values():
            write(shared, number)

    return (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": MICRO_BATCH}))
        .foreachBatch(deliver)
        .start()
    )


def batch_table(path: str) -> Callable[[DataFrame, int], None]:
    """Sink writing each batch to its own folder; a repeated batch overwrites itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def drain(stream: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Process all available input and return the result table.

    append: all rows; complete: the last full result; update: the last row of every key.
    """
    spark = stream.sparkSession
    base = new_work_path(spark, "stream")
    out = f"{base}/out"
    if mode == "append":
        query = (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", f"{base}/checkpoint")
            .option("path", out)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    query = fan_out(stream, {"table": batch_table(out)}, f"{base}/checkpoint", mode, {"availableNow": True})
    query.awaitTermination()
    results = spark.read.parquet(out)
    if mode == "complete":
        last = results.agg(F.max("batch")).first()[0]
        return results.filter(F.col("batch") == last).drop("batch")
    others = [c for c in stream.columns if c not in keys]
    newest = results.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return newest.select(*keys, "r.*")
