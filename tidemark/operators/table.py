"""A versioned table on parquet files with a commit log, row-level changes and a change feed.

Folders of a table: ``log`` (one JSON commit per version, now and then a parquet checkpoint of the active files), ``data``,
``changes`` (a folder of change files per commit, named by its version) and ``staging``.  A commit writes its files first and is
published by creating its log entry, which must not exist yet: of two writers of one version one gets a conflict.  Its folder of
changes is renamed into ``changes`` after that, and on opening a rename that was left out is made up for, so the feed never
shows a commit that did not happen.  Every commit with changes has the same number of change files, so a stream that takes a
multiple of it takes whole commits.

Only files that hold a row to change are rewritten; others stay in the table as they are.  The log keeps the least and the
greatest value of whole-number, date and short string columns of each file, by which a merge leaves files out unread; conditions
of deletes and updates reach the parquet scan, which does the same by row group.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from tidemark.functions.schema import conform, require_non_null
from tidemark.session import Files

CHANGE_TYPE, VERSION, TIMESTAMP = "_change_type", "_commit_version", "_commit_timestamp"
INSERT, DELETE, PREIMAGE, POSTIMAGE = "insert", "delete", "update_preimage", "update_postimage"
CHECKPOINT_EVERY = 10
FILE, PLACE = "__file", "__row"  # where a row of the table stands
LEAST_TEXT = 64  # longer least or greatest strings are not kept, and the file is read


class CommitConflict(RuntimeError):
    """Another writer has taken the version."""


def _as_column(condition: Column | str | None) -> Column:
    return F.lit(True) if condition is None else F.expr(condition) if isinstance(condition, str) else condition


def _holds(condition: Column | str | None) -> Column:
    """The condition, a null one counting as false."""
    return F.coalesce(_as_column(condition).cast("boolean"), F.lit(False))


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, self.path)
        if not self.files.exists("log"):
            raise FileNotFoundError(f"no versioned table at {path}")
        self._recover()

    # -- life of a table --

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, change_feed: bool = True, change_files: int | None = None) -> VersionedTable:
        """An empty table as version 0.

        ``change_files``: files that the changes of a commit are written to, by default one for each core there is now.
        """
        files, change_files = Files(spark, path), change_files or spark.sparkContext.defaultParallelism
        entry = {"version": 0, "operation": "create", "timestamp": time.time(), "schema": schema.jsonValue(), "cdf": change_feed, "change_files": change_files, "add": [], "stats": {}, "remove": [], "stage": None}
        try:
            files.create("log/" + _entry_name(0), json.dumps(entry))
        except FileExistsError as e:
            raise FileExistsError(f"there is a versioned table at {path}") from e
        return cls(spark, path)

    @classmethod
    def drop_if_exists(cls, spark: SparkSession, path: str) -> None:
        Files(spark, path).delete()

    def _recover(self) -> None:
        """Publish change files of commits whose writer stopped between log entry and rename."""
        staged = set(self.files.list("staging"))
        if staged:
            for entry in self._entries():
                if entry["stage"] in staged:
                    self._publish(entry)

    # -- log --

    def _entries(self, since: int = 0) -> list[dict]:
        names = [n for n in self.files.list("log") if n.endswith(".json") and int(n[:20]) >= since]
        return [json.loads(self.files.read(f"log/{n}")) for n in names]

    def version(self) -> int:
        return max(int(n[:20]) for n in self.files.list("log") if n.endswith(".json"))

    def _state(self, version: int | None = None) -> tuple[dict, dict[str, dict]]:
        """(last entry, active data files with their statistics) at a version, from the newest checkpoint on."""
        at = self.version() if version is None else version
        marks = [int(n[:20]) for n in self.files.list("log") if n.endswith(".checkpoint.parquet") and int(n[:20]) <= at]
        active: dict[str, dict] = {}
        start = 0
        if marks:
            start = max(marks) + 1
            rows = self.spark.read.parquet(f"{self.path}/log/{_entry_name(max(marks), 'checkpoint.parquet')}").collect()
            active = {r["file"]: json.loads(r["stats"]) for r in rows if r["file"]}
        last = None
        for entry in self._entries(min(start, at)):
            if entry["version"] > at:
                break
            last = entry
            if entry["version"] >= start:
                for f in entry["remove"]:
                    active.pop(f, None)
                active |= {f: entry["stats"].get(f, {}) for f in entry["add"]}
        if last is None or last["version"] != at:
            raise ValueError(f"no version {at}")
        return last, active

    @cached_property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.files.read("log/" + _entry_name(0)))["schema"])

    @property
    def change_schema(self) -> T.StructType:
        fields = [T.StructField(f.name, f.dataType, True) for f in self.schema]
        return T.StructType([*fields, T.StructField(CHANGE_TYPE, T.StringType()), T.StructField(VERSION, T.LongType()), T.StructField(TIMESTAMP, T.TimestampType())])

    def checkpoint(self) -> None:
        """Write the list of active files of this version as parquet; reading starts from there."""
        entry, active = self._state()
        rows = [(f, json.dumps(stats)) for f, stats in active.items()] or [(None, None)]
        stage = f"staging/checkpoint-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, "file string, stats string").coalesce(1).write.parquet(f"{self.path}/{stage}")
        target = f"log/{_entry_name(entry['version'], 'checkpoint.parquet')}"
        if not self.files.exists(target):
            self.files.rename(f"{stage}/{self.files.list(stage)[0]}", target)
        self.files.delete(stage)

    def detail(self) -> DataFrame:
        """One row: path, version, number of files, features."""
        entry, active = self._state()
        features = ["appendOnly", "invariants"] + ["changeDataFeed"] * entry["cdf"]
        row = (self.path, entry["version"], len(active), features)
        return self.spark.createDataFrame([row], "location string, version bigint, num_files bigint, table_features array<string>")

    def history(self) -> DataFrame:
        rows = [(e["version"], e["operation"], e["timestamp"]) for e in self._entries()]
        return self.spark.createDataFrame(rows, "version bigint, operation string, committed double").select("version", "operation", F.timestamp_seconds("committed").alias("timestamp"))

    # -- reading --

    def _read(self, files: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in files]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _placed(self, files: Iterable[str]) -> DataFrame:
        """Rows of data files, with the file and their place in it: names that a second reading gives again."""
        files = list(files)
        where = ("_metadata.file_path", "_metadata.row_index") if files else ("CAST(NULL AS string)", "CAST(NULL AS bigint)")
        return self._read(files).select("*", F.expr(where[0]).alias(FILE), F.expr(where[1]).alias(PLACE))

    def snapshot(self, version: int | None = None) -> DataFrame:
        return self._read(self._state(version)[1])

    def changes(self, start: int, end: int | None = None) -> DataFrame:
        """Change rows of the commits from ``start`` to ``end``, both included."""
        entry, _ = self._state()
        if not entry["cdf"]:
            raise ValueError("the table keeps no change feed")
        names = [n for n in self.files.list("changes") if start <= int(n) and (end is None or int(n) <= end)]
        if not names:
            return self.spark.createDataFrame([], self.change_schema)
        return self.spark.read.schema(self.change_schema).parquet(*(f"{self.path}/changes/{n}" for n in names))

    def stream_changes(self, start: int = 0, per_trigger: int | None = None) -> DataFrame:
        """The change feed as a stream; ``per_trigger`` commits (by default all there are) in a micro-batch."""
        entry, _ = self._state()
        if not entry["cdf"]:
            raise ValueError("the table keeps no change feed")
        self.files.mkdirs("changes")
        reader = self.spark.readStream.schema(self.change_schema).option("recursiveFileLookup", True)
        if per_trigger:
            reader = reader.option("maxFilesPerTrigger", per_trigger * entry["change_files"])
        return reader.parquet(f"{self.path}/changes").where(F.col(VERSION) >= start)

    # -- committing --

    def _publish(self, entry: dict) -> None:
        name = f"changes/{entry['version']:020d}"
        if entry["stage"] and not self.files.exists(name):
            self.files.rename(f"staging/{entry['stage']}", name)

    def _write_data(self, rows: DataFrame | None, folder: str) -> tuple[list[str], dict[str, dict]]:
        """Write data files; their names, and what is the least and the greatest in each by column."""
        if rows is None:
            return [], {}
        require_non_null(conform(rows, self.schema), self.schema).write.parquet(f"{self.path}/data/{folder}")
        added = [f"{folder}/{n}" for n in self.files.list(f"data/{folder}")]
        kept = [f.name for f in self.schema if _has_range(f.dataType)]
        if not kept:
            return added, {}
        both = [x for n in kept for x in (F.min(f"`{n}`"), F.max(f"`{n}`"))]
        # a row per file, as in the log entry that takes them
        found = self._read(added).groupBy(F.col("_metadata.file_path").alias(FILE)).agg(F.struct(*(x.cast("string").alias(f"v{i}") for i, x in enumerate(both))).alias("v"))
        stats = {}
        for row in found.collect():
            values, ranges = list(row["v"]), {}
            for i, n in enumerate(kept):
                low, high = values[2 * i], values[2 * i + 1]
                if low is not None and len(low) <= LEAST_TEXT and len(high) <= LEAST_TEXT:
                    ranges[n] = [low, high]
            stats |= {f: ranges for f in _match_names([row[FILE]], added)}
        return list(stats), stats  # a file without rows is not part of the table

    def _write_changes(self, changes: DataFrame | None, base: dict, version: int, now: float, stage: str) -> str | None:
        if changes is None or not base["cdf"]:
            return None
        out = changes.withColumn(VERSION, F.lit(version).cast("bigint")).withColumn(TIMESTAMP, F.timestamp_seconds(F.lit(now)))
        self.files.write_parts(out.select(*self.change_schema.names), f"staging/{stage}", base["change_files"])
        return stage

    def _commit(self, operation: str, base: dict, add: DataFrame | None, remove: list[str], changes: DataFrame | None, txn: tuple[str, int] | None = None) -> int:
        """Publish version base + 1; ``changes`` has the table's columns and the change type."""
        version, now, stage = base["version"] + 1, time.time(), uuid.uuid4().hex
        with ThreadPoolExecutor(2) as pool:  # two writes that do not wait for one another
            data = pool.submit(inheritable_thread_target(self.spark)(self._write_data), add, f"{version:020d}-{stage[:8]}")
            staged = pool.submit(inheritable_thread_target(self.spark)(self._write_changes), changes, base, version, now, stage)
        try:
            (added, stats), staged = data.result(), staged.result()
        except BaseException:
            self.files.delete(f"staging/{stage}")
            raise
        entry = base | {"version": version, "operation": operation, "timestamp": now, "add": added, "stats": stats, "remove": remove, "stage": staged, "batches": base.get("batches", {}) | (dict([txn]) if txn else {})}
        try:
            self.files.create("log/" + _entry_name(version), json.dumps(entry))
        except FileExistsError as e:
            self.files.delete(f"staging/{stage}")
            raise CommitConflict(f"version {version} of {self.path} was committed by another writer") from e
        self._publish(entry)
        if version % CHECKPOINT_EVERY == 0:
            self.checkpoint()
        return version

    @staticmethod
    def _done(base: dict, txn: tuple[str, int] | None) -> bool:
        """Whether this batch of this query was committed before (a stream may hand over a batch twice); each entry carries on
        the last batch of every query."""
        return txn is not None and base.get("batches", {}).get(txn[0], -1) >= txn[1]

    def write(self, df: DataFrame, mode: str = "append", txn: tuple[str, int] | None = None) -> int:
        """Add rows (append), or put them in place of all rows (overwrite)."""
        if mode not in ("append", "overwrite"):
            raise ValueError(f"mode {mode!r}")
        base, active = self._state()
        if self._done(base, txn):
            return base["version"]
        df = conform(df, T.StructType.fromJson(base["schema"]))
        changes = df.withColumn(CHANGE_TYPE, F.lit(INSERT))
        if mode == "overwrite" and active:
            changes = self._read(active).withColumn(CHANGE_TYPE, F.lit(DELETE)).union(changes)
        return self._commit(mode, base, df, list(active) if mode == "overwrite" else [], changes, txn)

    def _touched(self, active: Iterable[str], condition: Column | str | None) -> list[str]:
        """Names of the data files that hold a row for which the condition holds.

        The condition stands bare in the filter, so that what of it can be pushed down reaches the scan.
        """
        rows = self._placed(active).where(_as_column(condition).cast("boolean")).select(FILE).distinct().collect()
        return _match_names([r[FILE] for r in rows], active)

    def delete(self, condition: Column | str | None = None) -> int:
        """Remove the rows for which the condition holds; a null condition keeps the row."""
        base, active = self._state()
        touched = self._touched(active, condition)
        if not touched:
            return self._commit("delete", base, None, [], None)
        rows = self._read(touched)
        return self._commit("delete", base, rows.where(~_holds(condition)), touched, rows.where(_as_column(condition).cast("boolean")).withColumn(CHANGE_TYPE, F.lit(DELETE)))

    def update(self, condition: Column | str | None, assignments: dict[str, Column | str]) -> int:
        """Give columns new values in the rows for which the condition holds."""
        base, active = self._state()
        names = T.StructType.fromJson(base["schema"]).names
        unknown = [c for c in assignments if c not in names]
        if unknown:
            raise ValueError(f"the table has no columns {unknown}; it has {names}")
        touched = self._touched(active, condition)
        if not touched:
            return self._commit("update", base, None, [], None)
        rows = self._read(touched)
        new = {c: _as_column(v) for c, v in assignments.items()}
        image = [new.get(c, F.col(f"`{c}`")).alias(c) for c in names]
        hit = rows.where(_as_column(condition).cast("boolean"))
        changes = hit.withColumn(CHANGE_TYPE, F.lit(PREIMAGE)).unionByName(conform(hit.select(*image), self.schema).withColumn(CHANGE_TYPE, F.lit(POSTIMAGE)))
        after = rows.select(*(F.when(_holds(condition), new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in names))
        return self._commit("update", base, after, touched, changes)

    def merge(self, source: DataFrame, on: Column | str, key: str | None = None) -> Merge:
        """Bring in a source; the table is called ``target`` and the source ``source`` in ``on`` and in all clauses.

        ``key``: a column of both, given where ``on`` holds only for rows that are equal in it; files whose keys lie outside
        of the source's are then left out unread.
        """
        return Merge(self, source, on, key)


def _entry_name(version: int, kind: str = "json") -> str:
    return f"{version:020d}.{kind}"


def _has_range(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType | T.DateType) or kind == T.StringType()


def _match_names(uris: list[str], active: Iterable[str]) -> list[str]:
    """Names of active files among the locations that Spark gives."""
    tails = {"/".join(u.rsplit("/", 2)[-2:]) for u in uris}
    return [f for f in active if f in tails]


@dataclass
class _Clause:
    kind: str  # update, delete or insert
    condition: Column
    values: dict[str, Column | str] | None = None  # None: all columns of the table from the source


@dataclass
class Merge:
    """Clauses are tried in order, the first whose condition holds is taken; a row for which none does stays as it is."""

    table: VersionedTable
    source: DataFrame
    on: Column | str
    key: str | None = None
    matched: list[_Clause] = field(default_factory=list)
    not_matched: list[_Clause] = field(default_factory=list)

    def when_matched_update(self, values: dict[str, Column | str] | None = None, condition: Column | str | None = None) -> Merge:
        self.matched.append(_Clause("update", _holds(condition), values))
        return self

    def when_matched_delete(self, condition: Column | str | None = None) -> Merge:
        self.matched.append(_Clause("delete", _holds(condition)))
        return self

    def when_not_matched_insert(self, values: dict[str, Column | str] | None = None, condition: Column | str | None = None) -> Merge:
        self.not_matched.append(_Clause("insert", _holds(condition), values))
        return self

    def _near(self, source: DataFrame, active: dict[str, dict]) -> tuple[list[str], Column]:
        """Files that may hold a key of the source, and a condition on the table's key that the scan understands."""
        kinds = [df.schema[self.key].dataType if self.key in df.columns else None for df in (self.table._read([]), source)] if self.key else [None]
        if None in kinds or not (all(isinstance(k, T.IntegralType) for k in kinds) or kinds[0] == kinds[1] and _has_range(kinds[0])):
            return list(active), F.lit(True)
        low, high = source.agg(F.min(f"`{self.key}`"), F.max(f"`{self.key}`")).first()
        if low is None:
            return [], F.lit(False)  # no key, so nothing is equal to it

        def meets(stats: dict) -> bool:
            if self.key not in stats:
                return True
            least, greatest = (int(v) if isinstance(kinds[0], T.IntegralType) else v for v in stats[self.key])
            first, last = (low, high) if isinstance(kinds[0], T.IntegralType) else (str(low), str(high))
            return least <= last and first <= greatest

        return [f for f, stats in active.items() if meets(stats)], F.col(f"`{self.key}`").between(F.lit(low), F.lit(high))

    def execute(self, txn: tuple[str, int] | None = None) -> int:
        """One commit.  Two source rows that match one target row are an error; those that match nothing are inserted as they are.

        The source's rows are joined to the table's once and written with both images; rows of the table that no clause takes
        are not carried along, but read again and copied by an anti join on their places.
        """
        table, spark = self.table, self.table.spark
        base, active = table._state()
        if table._done(base, txn):
            return base["version"]
        names = table.schema.names
        on = _as_column(self.on)
        for clause in self.matched + self.not_matched:
            wanted = clause.values if clause.values is not None else names if clause.kind != "delete" else []
            unknown = [c for c in wanted if c not in names] + [c for c in names if clause.kind != "delete" and clause.values is None and c not in self.source.columns]
            if unknown:
                raise ValueError(f"columns {unknown} are not in the table, or not in the source")
        stage = f"{table.path}/staging/merge-{uuid.uuid4().hex}"
        try:
            # the source may be a stream's batch or not repeatable: written once
            self.source.write.parquet(f"{stage}/source")
            source = spark.read.schema(self.source.schema).parquet(f"{stage}/source").alias("source")
            near, between = self._near(source, active)
            hit = table._placed(near).where(between).alias("target").join(source, on, "left_semi").select(FILE).distinct().collect()
            touched = _match_names([r[FILE] for r in hit], near)
            joined = source.join(table._placed(touched).where(between).alias("target"), on, "left")
            both = F.col(f"target.{FILE}").isNotNull()

            def chain(clauses: list[_Clause], offset: int) -> Column:
                return reduce(lambda c, p: F.when(p[1].condition, offset + p[0]).otherwise(c), reversed(list(enumerate(clauses))), F.lit(-1))

            def value(name: str) -> Column:
                out = F.col(f"target.`{name}`")
                for i, clause in [*enumerate(self.matched), *enumerate(self.not_matched, 100)]:
                    if clause.kind == "delete":
                        continue
                    given = (clause.values or {}).get(name)
                    new = F.col(f"source.`{name}`") if clause.values is None else _as_column(given) if given is not None else F.lit(None) if i >= 100 else F.col(f"target.`{name}`")
                    out = F.when(F.col("_action") == i, new).otherwise(out)
                return out

            # names of both sides may clash, so the action is worked out beside them and the images in one select
            flat = joined.withColumn("_action", F.when(both, chain(self.matched, 0)).otherwise(chain(self.not_matched, 100)))
            images = [F.col(f"target.{c}").alias(c) for c in (FILE, PLACE)]
            flat.select(*images, "_action", F.struct(*(F.col(f"target.`{n}`").alias(n) for n in names)).alias("old"), F.struct(*(value(n).alias(n) for n in names)).alias("new")).write.parquet(f"{stage}/joined")
            rows = spark.read.parquet(f"{stage}/joined")
            # by row of the table, then by file: what comes here is a row per file to rewrite, and one for all inserts
            per_row = rows.groupBy(FILE, PLACE).agg(F.count("*").alias("n"), F.max("_action").alias("a")).where("a >= 0")
            taken = per_row.groupBy(FILE).agg(F.max(F.col("n") > 1).alias("again")).collect()
            if not taken:
                return table._commit("merge", base, None, [], None, txn)
            if any(r["again"] for r in taken if r[FILE] is not None):
                raise ValueError("several source rows match one row of the table")
            rewritten = _match_names([r[FILE] for r in taken if r[FILE] is not None], touched)
            deletes = [i for i, c in enumerate(self.matched) if c.kind == "delete"]
            updates = [i for i, c in enumerate(self.matched) if c.kind == "update"]
            inserts = list(range(100, 100 + len(self.not_matched)))
            gone = rows.where(F.col(FILE).isNotNull() & (F.col("_action") >= 0)).select(FILE, PLACE)
            after = rows.where(F.col("_action").isin(updates + inserts)).select("new.*")
            if rewritten:
                after = table._placed(rewritten).join(gone, [FILE, PLACE], "left_anti").select(*(F.col(f"`{n}`") for n in names)).unionByName(after)
            # both images of an updated row come from one reading
            kinds = F.when(F.col("_action").isin(deletes), F.array(F.struct(F.lit(DELETE).alias("kind"), F.col("old").alias("image"))))
            kinds = kinds.when(F.col("_action").isin(updates), F.array(F.struct(F.lit(PREIMAGE).alias("kind"), F.col("old").alias("image")), F.struct(F.lit(POSTIMAGE).alias("kind"), F.col("new").alias("image"))))
            kinds = kinds.otherwise(F.array(F.struct(F.lit(INSERT).alias("kind"), F.col("new").alias("image"))))
            changes = rows.where("_action >= 0").select(F.inline(kinds)).select("image.*", F.col("kind").alias(CHANGE_TYPE))
            return table._commit("merge", base, after, rewritten, changes, txn)
        finally:
            table.files.delete(stage[len(table.path) + 1 :])
