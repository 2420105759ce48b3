"""Stateful processors: a running sum, and the members of a group under additions and removals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.session import STATE_STORE


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class RunningSum(StatefulProcessor):
    """Emits (key, total so far) for each key of a micro-batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("sum", "total bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.total.get()
        total = (before[0] if before else 0) + sum(r["value"] for r in rows if r["value"] is not None)
        self.total.update((total,))
        yield Row(key=key[0], total=total)

    def close(self) -> None:
        pass


def running_sum(stream: DataFrame, key: str, value: str, event_time: str | None = None, delay: str = "0 seconds", output: str = "Update") -> DataFrame:
    """(key string, total bigint) of a stream's integers.

    With a column of event times, rows that come later than the watermark, ``delay`` behind the latest, are left out.  ``output`` is
    the operator's output mode, which the query's has to agree with.
    """
    use_state_store(stream.sparkSession)
    by = ["key", event_time] if event_time else ["key"]
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(value).cast("bigint").alias("value"), *by[1:])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by(by).aggregate([("value", "sum")]).rename_columns({"value_sum": "value"})
            yield from sums.select(batch.schema.names).to_batches()

    # what one key has in an Arrow batch is one row before it is shuffled, so a hot key is no hot partition
    rows = rows.mapInArrow(combine, rows.schema)
    if event_time:
        rows = rows.withWatermark(event_time, delay)
    return rows.groupBy("key").transformWithState(RunningSum(), "key string, total bigint", output, "EventTime" if event_time else "None")


class GroupMembers(StatefulProcessor):
    """Keeps the members of a group: Remove drops a member by id, Add puts it, or its new version, at the end.

    Changes of a batch are taken by version, removals first.  A member is a state cell of its own with the number of its
    insertion, so a batch writes what it changes and no more.  The list is emitted in each batch that touches the group, also when
    it has become empty.
    """

    def __init__(self, fields: T.StructType, member_id: str):
        self.fields, self.names, self.member_id = fields, fields.names, member_id

    def init(self, handle: StatefulProcessorHandle) -> None:
        kind = T.StructType([T.StructField("place", T.LongType()), T.StructField("member", self.fields)])
        self.members = handle.getMapState("members", T.StructType([self.fields[self.member_id]]), kind)
        self.places = handle.getValueState("places", "n bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last: dict = {}  # by id, in the order of insertion; None for one that is gone
        for r in sorted(rows, key=lambda r: (r["_version"], r["_type"] != "Remove")):
            last.pop(r[self.member_id], None)
            last[r[self.member_id]] = tuple(r[n] for n in self.names) if r["_type"] == "Add" else None
        first = self.places.get()
        place = first[0] if first else 0
        held = {k[0]: tuple(v) for k, v in self.members.iterator()} if first else {}
        for member, new in last.items():
            if new is not None:
                held[member] = (place, new)
                self.members.updateValue((member,), (place, new))
                place += 1
            elif held.pop(member, None) is not None:
                self.members.removeKey((member,))
        self.places.update((place,))
        yield Row(group=key[0], members=[Row(**dict(zip(self.names, m, strict=True))) for _, m in sorted(held.values(), key=lambda v: v[0])])

    def close(self) -> None:
        pass


def group_members(changes: DataFrame, group: str, member_id: str) -> DataFrame:
    """(group, members) of a stream of row changes (entity, version, _type); ``group`` is a string field of the entity."""
    use_state_store(changes.sparkSession)
    entity = changes.schema["entity"].dataType
    flat = changes.select(*(F.col(f"entity.`{n}`").alias(n) for n in entity.names), F.col("version").alias("_version"), "_type", F.col(f"entity.`{group}`").alias("_group"))
    processor = GroupMembers(entity, member_id)
    return flat.groupBy("_group").transformWithState(processor, f"group string, members array<{entity.simpleString()}>", "Update", "None")
