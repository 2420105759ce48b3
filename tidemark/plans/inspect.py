"""Looking at plans, expressions and placement."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession


def plan_text(df: DataFrame, mode: str = "extended") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def optimized_plan(df: DataFrame) -> str:
    return re.search(r"== Optimized Logical Plan ==\n(.*?)\n\n?==", plan_text(df), re.S)[1]


def pushed_filters(df: DataFrame) -> list[str]:
    """What reaches the file scans, a string per scan."""
    return re.findall(r"PushedFilters: \[(.*?)\]", plan_text(df))


def read_columns(df: DataFrame) -> list[str]:
    """What scans read, a string per scan."""
    return re.findall(r"ReadSchema: struct<(.*?)>", plan_text(df))


def expression_text(column: Column) -> str:
    return re.fullmatch(r"Column<'(.*)'>", str(column), re.S)[1]


def evaluate(spark: SparkSession, column: Column):
    """The value of an expression without input."""
    return spark.range(1).select(column.alias("v")).first()["v"]


def lineage(df: DataFrame) -> tuple[int, str]:
    """Partition count and lineage."""
    rdd = df.rdd
    return rdd.getNumPartitions(), rdd.toDebugString().decode("utf-8")


def settings(spark: SparkSession) -> dict[str, str]:
    return dict(spark.sparkContext.getConf().getAll()) | {"version": spark.version, "parallelism": str(spark.sparkContext.defaultParallelism)}
