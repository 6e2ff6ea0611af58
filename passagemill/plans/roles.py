"""The operators' inputs as views of the test tables: files, passages, snapshots, symbols, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions.kinds import kind_number
from passagemill.operators.usage import event_savings
from passagemill.session import spread

# Which usage event each raw event stands for; two event types never occur.
EVENT_OF = {
    "view": "search_code",
    "click": "search_similar",
    "purchase": "find_symbol",
    "signup": "summarize_codebase",
    "error": "list_concepts",
}


# Text tables by their key: the work per row is heavy, so all cores should take part.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan, TEXT_TABLES[name]) if name in TEXT_TABLES else scan


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filepath (source/language/id), content, language, mtime."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("filepath"),
        F.col("text").alias("content"),
        F.col("lang").alias("language"),
        F.col("n_chars").cast("double").alias("mtime"),
    )


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents whole: id, filepath, content, start_line, end_line, language, embedding.

    Document d has the vector d modulo the number of vectors, which are fewer.
    """
    vectors = table(spark, sf_dir, "embeddings")
    n = vectors.count()
    return files(spark, sf_dir).join(vectors, F.pmod(F.col("doc_id"), F.lit(n)) == F.col("vec_id")).select(
        F.col("filepath").alias("id"),
        "doc_id",
        "filepath",
        "content",
        F.lit(1).alias("start_line"),
        F.size(F.split("content", "\n", -1)).alias("end_line"),
        "language",
        "embedding",
        F.col("label").alias("cluster_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"))


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """The stored vector a search starts from."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


def stored_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at the last indexing, when German was left out."""
    return files(spark, sf_dir).filter("language <> 'de'")


def current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files now, with French left out; a label moves the file's time forward or back."""
    marks = (
        table(spark, sf_dir, "labels")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    shift = F.coalesce("quality", F.lit(0)) - F.coalesce("toxic", F.lit(0)) * 2
    return (
        files(spark, sf_dir)
        .filter("language <> 'fr'")
        .join(marks, "doc_id", "left")
        .select("doc_id", "filepath", "content", "language", (F.col("mtime") + shift).alias("mtime"))
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region > nation > customers (methods) and suppliers (functions) as a symbol tree."""
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("top"))
    nation = (
        table(spark, sf_dir, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "top", F.col("n_name").alias("middle"))
    )
    module, klass, method, function = (kind_number(k) for k in ("Module", "Class", "Method", "Function"))

    def row(df: DataFrame, path, parent, kinds, line) -> DataFrame:
        parts = F.split(path, "/")
        return df.select(
            F.concat(F.col("top"), F.lit(".tree")).alias("filepath"),
            F.element_at(parts, -1).alias("name"),
            path.alias("name_path"),
            parent.alias("parent_path"),
            F.lit(kinds[-1]).alias("kind"),
            F.array(*[F.lit(k) for k in kinds]).alias("kind_path"),
            F.lit(len(kinds) - 1).alias("depth"),
            line.cast("int").alias("start_line"),
            line.cast("int").alias("end_line"),
        )

    top = F.concat(F.lit("/"), F.col("top"))
    middle = F.concat(top, F.lit("/"), F.col("middle"))
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        row(region, top, F.lit(None).cast("string"), [module], F.col("r_regionkey") + 1)
        .unionByName(row(nation, middle, top, [module, klass], F.col("n_nationkey") + 1))
        .unionByName(
            row(customer, F.concat(middle, F.lit("/"), F.col("c_name")), middle, [module, klass, method], F.col("c_custkey") + 1)
        )
        .unionByName(
            row(supplier, F.concat(middle, F.lit("/"), F.col("s_name")), middle, [module, klass, function], F.col("s_suppkey") + 1)
        )
    )


def usage_calls(events: DataFrame) -> DataFrame:
    """Raw events as tool calls; works on a batch or a streaming frame. Night calls come from agents."""
    kinds = F.create_map(*[F.lit(x) for pair in EVENT_OF.items() for x in pair])
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.try_element_at(kinds, F.col("event_type")).alias("type"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.floor(F.col("value") * 100).alias("chars_returned"),
        F.get_json_object("props", "$.k").cast("long").alias("matched"),
        F.when(F.hour("ts") < 8, F.lit("agents")).otherwise(F.lit("main")).alias("origin"),
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_savings(usage_calls(table(spark, sf_dir, "events")))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every write to a keyed note: the turns of a conversation, later turns newer."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("note-"), F.col("conv_id").cast("string")).alias("name"),
        F.col("text").alias("content"),
        F.col("turn").alias("modified_at"),
    )


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues; a low priority counts as none, P is blocked and F closed."""
    state = F.create_map(*[F.lit(x) for x in ("O", "open", "P", "blocked", "F", "closed")])
    priority = F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("T-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.concat_ws(" ", F.lit("customer"), F.col("o_custkey").cast("string")).alias("description"),
        state[F.col("o_orderstatus")].alias("status"),
        F.when(priority < 5, priority).alias("priority"),
    )
