"""From raw change rows to ordered additions and removals, and from logs of upserts and tombstones to merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.table import CHANGE_TYPE, DELETE, INSERT, POSTIMAGE, PREIMAGE, TIMESTAMP, VERSION, VersionedTable

ADD, REMOVE, UPSERT, TOMBSTONE = "Add", "Remove", "Upsert", "Tombstone"


def entity_struct(columns: list[str], name: str = "entity") -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias(name)


def raw_changes(feed: DataFrame) -> DataFrame:
    """entity, changeType, commitVersion, commitTimestamp of a feed (batch or stream)."""
    columns = [c for c in feed.columns if c not in (CHANGE_TYPE, VERSION, TIMESTAMP)]
    return feed.select(entity_struct(columns), F.col(CHANGE_TYPE).alias("changeType"), F.col(VERSION).alias("commitVersion"), F.col(TIMESTAMP).alias("commitTimestamp"))


def sort_raw_changes(raw: DataFrame) -> DataFrame:
    """By version, what takes away before what adds."""
    hint = F.when(F.col("changeType").isin(DELETE, PREIMAGE), 0).otherwise(1)
    return raw.withColumn("_hint", hint).orderBy("commitVersion", "_hint").drop("_hint")


def row_changes(raw: DataFrame) -> DataFrame:
    """entity, version, _type: Add for insert and postimage, Remove for delete and preimage; another type fails the job."""
    kind = F.col("changeType")
    fail = F.raise_error(F.concat(F.lit("unknown change type "), F.coalesce(kind, F.lit("null")))).cast("string")
    return raw.select("entity", F.col("commitVersion").alias("version"), F.when(kind.isin(INSERT, POSTIMAGE), ADD).when(kind.isin(DELETE, PREIMAGE), REMOVE).otherwise(fail).alias("_type"))


def sort_row_changes(changes: DataFrame) -> DataFrame:
    return changes.withColumn("_hint", F.when(F.col("_type") == REMOVE, 0).otherwise(1)).orderBy("version", "_hint").drop("_hint")


def merge_source(log: DataFrame, key: str) -> DataFrame:
    """A log of (key, entity, _type) as a merge source: the key under the table's name, the entity's other fields, _type."""
    fields = [f.name for f in log.schema["entity"].dataType if f.name != key]
    return log.select(F.col("key").alias(key), *(F.col(f"entity.`{f}`").alias(f) for f in fields), "_type")


def all_other_null(columns: list[str], key: str) -> Column:
    """Whether every column but the key is null: a tombstone without a marker."""
    return reduce(lambda a, b: a & b, (F.col(f"source.`{c}`").isNull() for c in columns if c != key), F.lit(True))


def _same(key: str) -> Column:
    return F.col(f"target.`{key}`") == F.col(f"source.`{key}`")


def upsert(table: VersionedTable, source: DataFrame, key: str, txn: tuple[str, int] | None = None) -> int:
    return table.merge(source, _same(key), key).when_matched_update().when_not_matched_insert().execute(txn)


def update_only(table: VersionedTable, source: DataFrame, key: str, txn: tuple[str, int] | None = None) -> int:
    return table.merge(source, _same(key), key).when_matched_update().execute(txn)


def upsert_with_tombstones(table: VersionedTable, source: DataFrame, key: str, txn: tuple[str, int] | None = None) -> int:
    """A row of which all but the key is null deletes; one for a missing key does nothing."""
    gone = all_other_null(source.columns, key)
    return table.merge(source, _same(key), key).when_matched_delete(gone).when_matched_update().when_not_matched_insert(condition=~gone).execute(txn)


def upsert_log(table: VersionedTable, log: DataFrame, key: str, txn: tuple[str, int] | None = None) -> int:
    """Tombstones delete, upserts update or insert."""
    kind = F.col("source._type")
    merge = table.merge(merge_source(log, key), _same(key), key).when_matched_delete(kind == TOMBSTONE)
    return merge.when_matched_update(condition=kind == UPSERT).when_not_matched_insert(condition=kind == UPSERT).execute(txn)
