"""Readers with a schema and a parse mode; small frames; strings parsed as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERMISSIVE, FAILFAST, DROP = "PERMISSIVE", "FAILFAST", "DROPMALFORMED"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, mode: str = FAILFAST) -> DataFrame:
    """CSV; without a schema Spark reads the file twice to infer one."""
    reader = spark.read.option("header", header).option("mode", mode)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, mode: str = FAILFAST) -> DataFrame:
    """JSON lines.  Malformed rows fail (FAILFAST) or lose the field (PERMISSIVE); a null is not malformed."""
    reader = spark.read.option("mode", mode)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A column ``value`` with the lines of text files."""
    return spark.read.text(path)


def parse_json(lines: DataFrame, schema: T.StructType | str, mode: str = FAILFAST, column: str = "value") -> DataFrame:
    """Lines of JSON as columns, by an expression: stays in the plan, and keeps null as null."""
    return lines.select(F.from_json(F.col(column), schema, {"mode": mode}).alias("parsed")).select("parsed.*")


def read_json_strings(lines: DataFrame, schema: T.StructType | str, mode: str = FAILFAST, column: str = "value") -> DataFrame:
    """Lines of JSON through the file reader; the legacy setting on nullability holds for this way only."""
    strings = lines.select(column).rdd.map(lambda r: r[0])
    return lines.sparkSession.read.schema(schema).option("mode", mode).json(strings)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def values(spark: SparkSession, items: list, kind: str = "int") -> DataFrame:
    """Atoms as a frame with one column ``value``."""
    return spark.createDataFrame([(x,) for x in items], f"value {kind}")


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
