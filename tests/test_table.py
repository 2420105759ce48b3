import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import cdc
from tidemark.operators.table import CommitConflict, VersionedTable
from tidemark.streaming import sinks

USER = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), True)])
BASE = [(1, "Alice"), (2, "Bob"), (3, "Charlie"), (4, "Dave")]


@pytest.fixture
def users(spark, folder):
    t = VersionedTable.create(spark, f"{folder}/users", USER)
    t.write(rows(spark, BASE))
    return t


def rows(spark, data):
    return spark.createDataFrame(data, "id bigint, name string")


def state(t):
    return sorted(map(tuple, t.snapshot().collect()))


def feed(t, start=0):
    got = [(r["_commit_version"], r["_change_type"], r["id"], r["name"]) for r in t.changes(start).collect()]
    return sorted(got, key=str)


def test_create_is_empty_version_0(spark, folder):
    t = VersionedTable.create(spark, f"{folder}/t", USER)
    assert t.version() == 0 and state(t) == [] and t.changes(0).count() == 0
    with pytest.raises(FileExistsError):
        VersionedTable.create(spark, f"{folder}/t", USER)
    VersionedTable.drop_if_exists(spark, f"{folder}/t")
    VersionedTable.drop_if_exists(spark, f"{folder}/t")
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, f"{folder}/t")


def test_delete_and_updates(users):
    users.delete("id = 1")
    users.update("id % 2 = 0", {"name": F.concat(F.lit("Dr. "), F.col("name"))})
    users.update(F.col("id") == 3, {"name": "concat('Mr. ', name)"})
    assert state(users) == [(2, "Dr. Bob"), (3, "Mr. Charlie"), (4, "Dr. Dave")]
    changes = feed(users)
    assert len(changes) == 11
    assert [c for c in changes if c[0] == 2] == [(2, "delete", 1, "Alice")]
    assert [c for c in changes if c[0] == 4] == [(4, "update_postimage", 3, "Mr. Charlie"), (4, "update_preimage", 3, "Charlie")]
    assert sorted(map(tuple, users.snapshot(1).collect())) == BASE
    assert [r["operation"] for r in users.history().orderBy("version").collect()] == ["create", "append", "delete", "update", "update"]


def test_null_condition_keeps_the_row(spark, folder):
    t = VersionedTable.create(spark, f"{folder}/n", USER)
    t.write(rows(spark, [(1, None), (2, "b")]))
    t.delete("name = 'b'")
    assert state(t) == [(1, None)]
    t.update("name <> 'x'", {"name": F.lit("y")})
    assert state(t) == [(1, None)]
    assert t.version() == 3


def test_unknown_column(users):
    with pytest.raises(ValueError, match="nme"):
        users.update("id = 1", {"nme": F.lit("x")})


def test_not_null_is_enforced(spark, users):
    with pytest.raises(Exception, match="null in id"):
        users.write(rows(spark, [(None, "x")]))
    assert users.version() == 1


def test_upsert_and_update_only(spark, users):
    users.delete("id = 1")
    cdc.upsert(users, rows(spark, [(2, "Dr. Bob"), (4, "Dr. Dave"), (5, "Dr. Davis")]), "id")
    cdc.update_only(users, rows(spark, [(3, "Mr. Charlie"), (4, "Super Dr. Dave"), (9, "nobody")]), "id")
    assert state(users) == [(2, "Dr. Bob"), (3, "Mr. Charlie"), (4, "Super Dr. Dave"), (5, "Dr. Davis")]
    assert len(feed(users)) == 14


def test_merge_rewrites_only_touched_files(spark, users):
    users.write(rows(spark, [(10, "x")]))
    before = set(users._state()[1])
    cdc.upsert(users, rows(spark, [(10, "y")]), "id")
    assert len(before & set(users._state()[1])) >= len(before) - 1 and (10, "y") in state(users)


def test_two_source_rows_for_one(spark, users):
    with pytest.raises(ValueError, match="several source rows"):
        cdc.upsert(users, rows(spark, [(2, "a"), (2, "b")]), "id")
    cdc.upsert(users, rows(spark, [(7, "a"), (7, "b")]), "id")
    assert state(users)[-2:] == [(7, "a"), (7, "b")]


def test_null_key_never_matches(spark, folder):
    t = VersionedTable.create(spark, f"{folder}/k", T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]))
    t.write(rows(spark, [(None, "a")]))
    cdc.upsert(t, rows(spark, [(None, "b")]), "id")
    assert state(t) == [(None, "a"), (None, "b")]


def test_clauses_in_order(spark, users):
    merge = users.merge(rows(spark, [(1, "one"), (2, "two"), (8, "eight")]), "target.id = source.id")
    merge.when_matched_delete("source.id = 1").when_matched_update({"name": F.concat("source.name", F.lit("!"))}).when_not_matched_insert({"id": F.col("source.id"), "name": F.lit("new")}).execute()
    assert state(users) == [(2, "two!"), (3, "Charlie"), (4, "Dave"), (8, "new")]


def test_overwrite_and_detail(spark, users):
    users.write(rows(spark, [(9, "z")]), "overwrite")
    assert state(users) == [(9, "z")]
    assert [c[1] for c in feed(users, 2)] == ["delete"] * 4 + ["insert"]
    d = users.detail().first()
    assert d["version"] == 2 and "changeDataFeed" in d["table_features"]


def test_without_feed(spark, folder):
    t = VersionedTable.create(spark, f"{folder}/f", USER, change_feed=False)
    t.write(rows(spark, BASE))
    with pytest.raises(ValueError, match="no change feed"):
        t.changes(0)


def test_checkpoints(spark, users):
    for i in range(10):
        users.write(rows(spark, [(100 + i, "x")]))
    assert any(n.endswith("checkpoint.parquet") for n in users.files.list("log"))
    assert len(state(VersionedTable(spark, users.path))) == 14
    assert len(users.snapshot(3).collect()) == 6


def test_conflict(spark, users):
    base, _ = users._state()
    users.write(rows(spark, [(5, "e")]))
    with pytest.raises(CommitConflict):
        users._commit("append", base, rows(spark, [(6, "f")]), [], None)
    assert len(state(users)) == 5


def test_missing_rename_is_made_up_for(spark, users):
    entry = json.loads(users.files.read("log/00000000000000000001.json"))
    users.files.rename("changes/00000000000000000001", f"staging/{entry['stage']}")
    assert users.changes(0).count() == 0
    assert VersionedTable(spark, users.path).changes(0).count() == 4


def test_same_batch_twice(spark, users):
    for _ in range(2):
        cdc.upsert(users, rows(spark, [(50, "a")]), "id", ("q", 3))
    assert users.version() == 2


def test_tombstones(spark, users):
    source = rows(spark, [(1, None), (77, None), (3, "Super"), (9, "Nine")])
    cdc.upsert_with_tombstones(users, source, "id")
    assert state(users) == [(2, "Bob"), (3, "Super"), (4, "Dave"), (9, "Nine")]


def test_log_goldens(spark, folder):
    kind = "key string, entity struct<`@id`:string,name:string>, offset bigint, _type string"
    t = VersionedTable.create(spark, f"{folder}/log", T.StructType([T.StructField("@id", T.StringType(), False), T.StructField("name", T.StringType())]))
    up = lambda i, n: (str(i), (str(i), n), None, "Upsert")
    for batch in (
        [up(i, n) for i, n in BASE],
        [up(2, "Dr. Bob"), up(4, "Dr. Dave"), up(5, "Dr. Davis")],
        [up(3, "Mr. Charlie"), up(4, "Super Dr. Dave")],
        [("5", None, None, "Tombstone"), up(3, "Super Mr. Charlie"), ("66", None, None, "Tombstone")],
    ):
        cdc.upsert_log(t, spark.createDataFrame(batch, kind), "@id")
    assert state(t) == [("1", "Alice"), ("2", "Dr. Bob"), ("3", "Super Mr. Charlie"), ("4", "Super Dr. Dave")]
    raw = cdc.raw_changes(t.changes(0))
    changes = cdc.row_changes(raw)
    assert raw.count() == 16 and changes.where("_type = 'Add'").count() == 10
    ordered = [(r["version"], r["_type"]) for r in cdc.sort_row_changes(changes).collect()]
    assert ordered == sorted(ordered, key=lambda x: (x[0], x[1] != "Remove"))
    hints = [(r["commitVersion"], r["changeType"] in ("insert", "update_postimage")) for r in cdc.sort_raw_changes(raw).collect()]
    assert hints == sorted(hints)


def test_unknown_change_type(spark):
    raw = spark.createDataFrame([((1,), "odd", 1, None)], "entity struct<id:bigint>, changeType string, commitVersion bigint, commitTimestamp timestamp")
    with pytest.raises(Exception, match="unknown change type"):
        cdc.row_changes(raw).collect()


def test_stream_holds_two_commits_in_a_batch(spark, users):
    users.delete("id = 1")
    users.write(rows(spark, [(5, "e")]))
    users.delete("id = 2")
    got = sinks.drain(users.stream_changes(0, per_trigger=2)).collect()
    assert sorted({(r["_batch"], r["_commit_version"]) for r in got}) == [(0, 1), (0, 2), (1, 3), (1, 4)]
    assert {r["_commit_version"] for r in sinks.drain(users.stream_changes(3)).collect()} == {3, 4}


def test_files_out_of_range_are_left_out(spark, users):
    users.write(rows(spark, [(100, "x"), (120, "y")]))
    near, _ = users.merge(rows(spark, [(100, "n")]), "target.id = source.id", "id")._near(rows(spark, [(100, "n")]), users._state()[1])
    assert len(near) == 1 and users._state()[1][near[0]]["id"][0] == "100"
    merge = users.merge(rows(spark, []), "target.id = source.id", "id")
    assert merge._near(rows(spark, []), users._state()[1])[0] == [] and merge._near(rows(spark, [(None, "z")]), users._state()[1])[0] == []
    by_name = users.merge(rows(spark, [(1, "Bob")]), "target.name = source.name", "name")
    assert len(by_name._near(rows(spark, [(1, "Bob")]), users._state()[1])[0]) >= 1
    for i in range(8):
        users.write(rows(spark, [(200 + i, "x" * 100)]))
    kept = VersionedTable(spark, users.path)._state()[1]  # from the checkpoint
    assert kept == users._state()[1] and all("id" in v for v in kept.values()) and any("name" not in v for v in kept.values())


def test_commits_have_equally_many_change_files(spark, folder):
    t = VersionedTable.create(spark, f"{folder}/c", USER, change_files=3)
    t.write(rows(spark, [(1, "a")]))
    t.write(rows(spark, [(i, "b") for i in range(2, 50)]))
    assert [len(t.files.list(f"changes/{n}")) for n in t.files.list("changes")] == [3, 3]
    got = sinks.drain(t.stream_changes(0, per_trigger=1)).collect()
    assert sorted({(r["_batch"], r["_commit_version"]) for r in got}) == [(0, 1), (1, 2)] and len(got) == 49


def test_only_files_with_a_change_are_rewritten(spark, users):
    before = set(users._state()[1])
    users.merge(rows(spark, [(2, "no"), (70, "new")]), "target.id = source.id", "id").when_matched_update(condition="source.name = 'yes'").when_not_matched_insert().execute()
    assert before < set(users._state()[1]) and state(users) == [*BASE, (70, "new")]
    assert feed(users, 2) == [(2, "insert", 70, "new")]
    users.merge(rows(spark, [(2, "no")]), "target.id = source.id", "id").when_matched_update(condition="source.name = 'yes'").execute()
    assert users.version() == 3 and feed(users, 3) == []


def test_merges_against_a_dictionary(spark, folder):
    import random

    dice, t, held = random.Random(5), VersionedTable.create(spark, f"{folder}/d", USER), {}
    for step in range(4):
        batch = {dice.randrange(30): dice.choice(["gone", None, f"v{step}"]) for _ in range(12)}
        merge = t.merge(rows(spark, list(batch.items())), "target.id = source.id", "id")
        merge.when_matched_delete("source.name = 'gone'").when_matched_update().when_not_matched_insert(condition="source.name is null or source.name <> 'gone'").execute()
        for k, v in batch.items():
            held.pop(k, None) if v == "gone" else held.update({k: v})
        assert state(t) == sorted(held.items())
    counted = {}
    for r in t.changes(0).collect():
        counted[(r["id"], r["name"])] = counted.get((r["id"], r["name"]), 0) + (1 if r["_change_type"] in ("insert", "update_postimage") else -1)
    assert {k for k, n in counted.items() if n} == set(held.items()) and set(counted.values()) <= {0, 1}
