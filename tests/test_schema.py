from dataclasses import dataclass, field
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import schema as S


@dataclass
class Attr:
    name: str
    value: str


@dataclass
class Node:
    local_id: str = field(metadata={"name": "_local_id"})
    urn: str = field(metadata={"name": "_urn"})
    attr: list[Attr] | None = None


@dataclass
class Net:
    nodes: list[Node]


@dataclass
class Adult:
    name: str
    age: S.Int
    birthday: S.Int | None


@dataclass
class Child:
    name: str
    age: S.Int
    birthday: S.Int | None
    guardian: str


@dataclass
class Senior:
    name: str
    age: S.Int
    birthday: S.Int | None
    pensionId: str


@dataclass
class Odd:
    name: int


def test_nested_schema():
    attr = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("value", T.StringType(), False)])
    node = T.StructType([T.StructField("_local_id", T.StringType(), False), T.StructField("_urn", T.StringType(), False), T.StructField("attr", T.ArrayType(attr, False), True)])
    assert S.schema_of(Net) == T.StructType([T.StructField("nodes", T.ArrayType(node, False), False)])


def test_atoms():
    @dataclass
    class All:
        a: S.Int
        b: int
        c: float
        d: bool
        e: datetime
        f: list[S.Int]
        g: tuple[int, int]
        h: dict[str, int | None]

    S.All = All
    got = S.schema_of(All)
    assert [f.dataType.simpleString() for f in got] == ["int", "bigint", "double", "boolean", "timestamp", "array<int>", "struct<_1:bigint,_2:bigint>", "map<string,bigint>"]
    assert not any(f.nullable for f in got)


def test_sum_type():
    got = S.sum_type(Adult, Child, Senior)
    assert [(f.name, f.nullable) for f in got] == [("name", False), ("age", False), ("birthday", True), ("guardian", True), ("pensionId", True), ("_type", False)]
    with pytest.raises(TypeError, match="name"):
        S.sum_type(Adult, Odd)


def test_variants_union(spark):
    person = S.sum_type(Adult, Child, Senior)
    a = S.frame_of(spark, [Adult("John", 30, None), Adult("Jane", 25, 1998)])
    c = S.frame_of(spark, [Child("Billy", 10, 2015, "John")])
    s = S.frame_of(spark, [Senior("George", 70, 1955, "SN123456")])
    both = S.to_variant(a, "Adult", person).unionByName(S.to_variant(c, "Child", person)).unionByName(S.to_variant(s, "Senior", person))
    rows = {r["name"]: r.asDict() for r in both.collect()}
    assert len(rows) == 4 and rows["Billy"]["guardian"] == "John" and rows["George"]["_type"] == "Senior" and rows["Jane"]["guardian"] is None


def test_round_trip(spark):
    net = Net([Node("1", "u", [Attr("a", "b")]), Node("2", "v", None)])
    row = S.frame_of(spark, [net]).first()
    assert S.from_row(Net, row) == net


def test_conform(spark):
    df = spark.createDataFrame([("1", 2.5, "x")], "a string, b double, c string")
    want = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("a", T.LongType())])
    assert S.conform(df, want).collect() == [(2, 1)]
    with pytest.raises(ValueError, match="missing"):
        S.conform(df.drop("a"), want)


def test_null_is_rejected_by_name(spark):
    with pytest.raises(PySparkException, match="name"):
        S.frame_of(spark, [Adult(None, 1, None)])
    widened = spark.createDataFrame([("x", 1, None), (None, 2, None)], "name string, age int, birthday int")
    with pytest.raises(Exception, match="null in name"):
        S.require_non_null(widened, S.schema_of(Adult)).collect()
    assert S.require_non_null(widened.limit(1), S.schema_of(Adult)).count() == 1


def test_nested_nulls(spark):
    kind = "nodes array<struct<_local_id:string,_urn:string,attr:array<struct<name:string,value:string>>>>"
    good = spark.createDataFrame([([("1", "u", None)],)], kind)
    assert S.require_non_null(good, S.schema_of(Net)).count() == 1
    bad = spark.createDataFrame([([None],)], kind)
    with pytest.raises(Exception, match=r"null in nodes\[\]"):
        S.require_non_null(bad, S.schema_of(Net)).collect()


def test_pack_struct(spark):
    df = spark.range(2).withColumn("x", F.lit("a"))
    assert df.select(S.pack_struct(df, "e")).select("e.*").collect() == df.collect()
