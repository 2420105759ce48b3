import pytest
from pyspark.sql import functions as F

from tidemark.functions import schema as S
from tidemark.sources.drip import DripFeed, rate, replay
from tidemark.streaming import sinks, stateful

PLACES = [[(1, "Paris"), (2, "Paris"), (3, "London"), (4, "Brazzaville"), (5, "New York")], [(1, "London")], [(1, "London")]]


def test_update_mode_repeats_keys(spark):
    feed = DripFeed(spark, "user_id bigint, location string")
    for batch in PLACES:
        feed.add(batch)
    grouped = feed.stream().groupBy("location").agg(F.collect_list("user_id").alias("users"))
    got = {(r["_batch"], r["location"]): sorted(r["users"]) for r in sinks.drain(grouped, "update").collect()}
    assert got == {(0, "Brazzaville"): [4], (0, "London"): [3], (0, "New York"): [5], (0, "Paris"): [1, 2], (1, "London"): [1, 3], (2, "London"): [1, 1, 3]}
    feed.drop()


def test_memory_sink(spark):
    feed = DripFeed(spark, "user_id bigint, location string")
    query = sinks.to_memory(feed.stream().groupBy("location").agg(F.collect_list("user_id").alias("users")), "places")
    for batch in PLACES[:2]:
        feed.add(batch)
        query.processAllAvailable()
    rows = spark.sql("SELECT location, size(users) AS n FROM places ORDER BY location, n").collect()
    query.stop()
    assert [tuple(r) for r in rows if r["location"] == "London"] == [("London", 1), ("London", 2)] and len(rows) == 5


def test_late_rows_count(spark):
    feed = DripFeed(spark, "ts timestamp, place string")
    day = lambda s: spark.sql(f"SELECT timestamp'{s}' AS ts, 'x' AS place")
    feed.add(day("2026-01-01 00:00:00"))
    feed.add(day("2020-01-01 00:00:00"))
    grouped = feed.stream().withWatermark("ts", "100 seconds").groupBy("place").count()
    assert sinks.latest(sinks.drain(grouped, "update"), "place").collect() == [("x", 2)]


def test_running_sum(spark):
    feed = DripFeed(spark, "id bigint")
    for _ in range(3):
        feed.add(spark.range(100))
    rows = feed.stream().select((F.col("id") % 10).alias("k"), F.lit(1).alias("v"))
    got = sinks.drain(stateful.running_sum(rows, "k", "v"), "update").collect()
    assert sorted((r["_batch"], r["key"], r["total"]) for r in got) == sorted((b, str(k), 10 * (b + 1)) for b in range(3) for k in range(10))


def test_group_members(spark):
    kind = "entity struct<id:string,name:string,location:string>, version bigint, _type string"
    row = lambda i, where, v, t="Add": ((i, f"n{i}", where), v, t)
    feed = DripFeed(spark, kind)
    feed.add([row("1", "Paris", 1), row("2", "Paris", 1), row("3", "London", 1), row("4", "Brazzaville", 1), row("5", "New York", 1), row("7", "Madrid", 1)])
    feed.add([row("6", "New York", 2), row("1", "Paris", 2, "Remove"), row("1", "London", 2), row("5", "New York", 2, "Remove"), row("5", "Brazzaville", 2)])
    feed.add([row("7", "Madrid", 3, "Remove"), row("7", "Paris", 3), row("7", "Paris", 4, "Remove"), row("7", "London", 4)])
    got = sinks.drain(stateful.group_members(feed.stream(), "location", "id"), "update").collect()
    assert {(r["_batch"], r["group"]): [m["id"] for m in r["members"]] for r in got} == {
        (0, "Brazzaville"): ["4"], (0, "London"): ["3"], (0, "Madrid"): ["7"], (0, "New York"): ["5"], (0, "Paris"): ["1", "2"],
        (1, "Brazzaville"): ["4", "5"], (1, "London"): ["3", "1"], (1, "New York"): ["6"], (1, "Paris"): ["2"],
        (2, "London"): ["3", "1", "7"], (2, "Madrid"): [], (2, "Paris"): ["2"],
    }


def test_rate_and_listener(spark):
    watch = sinks.Watch()
    spark.streams.addListener(watch)
    query = rate(spark, 100).writeStream.format("memory").queryName("rate_rows").start()
    import time

    for _ in range(100):
        if spark.sql("SELECT count(*) FROM rate_rows").first()[0] >= 200:
            break
        time.sleep(0.2)
    query.stop()
    assert spark.sql("SELECT count(*) FROM rate_rows").first()[0] % 100 == 0
    for _ in range(50):
        if watch.terminated:
            break
        time.sleep(0.1)
    spark.streams.removeListener(watch)
    assert watch.started and 100 in watch.rows


def test_replay_in_order(spark):
    got = sinks.drain(replay(spark.range(30).select((29 - F.col("id")).alias("id")), "id", 3)).collect()
    first = {b: [r["id"] for r in got if r["_batch"] == b] for b in range(3)}
    assert max(first[0]) < min(first[1]) and max(first[1]) < min(first[2]) and len(got) == 30


def test_merge_skips_empty_batches(spark, folder):
    from tidemark.operators.table import VersionedTable

    t = VersionedTable.create(spark, f"{folder}/m", S.T.StructType([S.T.StructField("id", S.T.LongType(), False)]))
    feed = DripFeed(spark, "id bigint")
    feed.add([(1,), (2,)])
    feed.add(spark.createDataFrame([], "id bigint"))
    sinks.merge_stream(feed.stream(), t, "id")
    assert t.version() == 1 and t.snapshot().count() == 2


def test_empty_stream(spark):
    feed = DripFeed(spark, "id bigint")
    assert sinks.drain(feed.stream()).count() == 0
    with pytest.raises(Exception):
        spark.table("no_such_table")
