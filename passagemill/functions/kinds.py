"""Symbol kinds: the public language-server numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kind number = position in this list, counted from 1.
KIND_NAMES = [
    "File",
    "Module",
    "Namespace",
    "Package",
    "Class",
    "Method",
    "Property",
    "Field",
    "Constructor",
    "Enum",
    "Interface",
    "Function",
    "Variable",
    "Constant",
    "String",
    "Number",
    "Boolean",
    "Array",
    "Object",
    "Key",
    "Null",
    "EnumMember",
    "Struct",
    "Event",
    "Operator",
    "TypeParameter",
]

# Kind of a chunk by its type; every other type is a Variable.
KIND_OF_CHUNK_TYPE = {
    "function": "Function",
    "class": "Class",
    "method": "Method",
    "interface": "Interface",
    "type": "TypeParameter",
    "variable": "Variable",
    "import": "Module",
}


def kind_number(name: str) -> int | None:
    """Number of a kind name, ignoring case; None if there is no such kind."""
    lowered = [k.lower() for k in KIND_NAMES]
    return lowered.index(name.lower()) + 1 if name.lower() in lowered else None


def kind_name(kind: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(k) for k in KIND_NAMES]), kind.cast("int"))


def parse_kind(name: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(k.lower()) for k in KIND_NAMES]), F.lower(name))
    return F.when(position > 0, position.cast("int"))


def chunk_type_kind(chunk_type: Column) -> Column:
    table = F.create_map(
        *[F.lit(x) for t, k in KIND_OF_CHUNK_TYPE.items() for x in (t, kind_number(k))]
    )
    return F.coalesce(F.try_element_at(table, chunk_type), F.lit(kind_number("Variable")))


def kinds_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(KIND_NAMES, start=1)), "kind int, kind_name string")
