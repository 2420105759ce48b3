"""Streams for tests and replays: one call is one micro-batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import Files, shared_dir


class DripFeed:
    """A stream source that is fed batch by batch: ``add`` publishes a folder by renaming it into the watched one.

    Each batch has ``parts`` files, so a stream that takes that many at a time takes whole batches.
    """

    def __init__(self, spark: SparkSession, schema: T.StructType | str, parts: int = 1):
        self.spark, self.schema, self.parts = spark, schema, parts
        self.path = f"{shared_dir(spark)}/drip-{uuid.uuid4().hex[:12]}"
        self.files = Files(spark, self.path)
        self.files.mkdirs("feed")
        self.count = 0

    def add(self, rows: list | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema)
        stage = f"stage-{self.count}"
        self.files.write_parts(df, stage, self.parts)
        self.files.rename(stage, f"feed/{self.count:06d}")
        self.count += 1

    def stream(self, per_trigger: int = 1) -> DataFrame:
        reader = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True)
        return reader.option("maxFilesPerTrigger", per_trigger * self.parts).parquet(f"{self.path}/feed")

    def drop(self) -> None:
        self.files.delete()


def rate(spark: SparkSession, rows_per_batch: int = 100) -> DataFrame:
    """timestamp, value: a fixed number of rows in each micro-batch."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()


def replay(df: DataFrame, column: str, batches: int) -> DataFrame:
    """A table as a stream of ``batches`` micro-batches in the order of a numeric column.

    Batches are written to the shared folder one after another, each by all cores: a file stream takes files by age.
    """
    feed = DripFeed(df.sparkSession, df.schema, df.sparkSession.sparkContext.defaultParallelism)
    cuts = df.approxQuantile(column, [i / batches for i in range(1, batches)], 0.0) if batches > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = df if low is None else df.filter(F.col(column) > low)
        feed.add(part if high is None else part.filter(F.col(column) <= high))
    return feed.stream()
