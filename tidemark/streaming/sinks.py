"""Where streams end: drained into a table of all emitted rows, merged into a versioned table, or watched."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.operators import cdc
from tidemark.operators.table import VersionedTable
from tidemark.session import Files, shared_dir


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that its source has now; the rows it emitted, with the micro-batch as ``_batch``.

    ``each`` changes a micro-batch before it is written.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/drain-{uuid.uuid4().hex[:12]}"
    seen: dict = {}

    def write(batch: DataFrame, number: int) -> None:
        out = each(batch, number) if each else batch
        seen.setdefault("schema", out.schema)
        # a batch that is handed over again replaces what it wrote before
        out.withColumn("_batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0).cast("bigint"))
    return spark.read.schema(T.StructType([*seen["schema"], T.StructField("_batch", T.LongType())])).parquet(*(f"{root}/out/{n}" for n in Files(spark, root).list("out")))


def latest(emitted: DataFrame, key: str) -> DataFrame:
    """The last row emitted for each key."""
    columns = [c for c in emitted.columns if c != "_batch"]
    last = emitted.groupBy(key).agg(F.max_by(F.struct(*columns), "_batch").alias("_last"))
    return last.select("_last.*")


def to_memory(stream: DataFrame, name: str, mode: str = "update"):
    """A query into a table of the driver's memory, for tests: in update mode changed rows are appended, so keys repeat."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).start()


def to_console(stream: DataFrame, mode: str = "update"):
    return stream.writeStream.format("console").option("truncate", False).outputMode(mode).start()


def merge_stream(stream: DataFrame, table: VersionedTable, key: str, step: Callable = cdc.upsert, available_now: bool = True):
    """Merge each non-empty micro-batch into a table as one commit; a batch that is handed over again is skipped."""
    spark = stream.sparkSession
    name = f"merge-{uuid.uuid4().hex[:12]}"

    def merge(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            step(table, batch, key, (name, number))

    writer = stream.writeStream.option("checkpointLocation", f"{shared_dir(spark)}/{name}").foreachBatch(merge)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        query.awaitTermination()
    return query


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` for each key."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


class Watch(StreamingQueryListener):
    """Counts what queries do."""

    def __init__(self):
        self.started, self.rows, self.terminated = [], [], []

    def onQueryStarted(self, event):
        self.started.append(str(event.id))

    def onQueryProgress(self, event):
        self.rows.append(event.progress.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.terminated.append(str(event.id))
