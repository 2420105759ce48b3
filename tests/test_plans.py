import pytest
from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.plans import inspect
from tidemark.queries import QUERIES, table
from tests.conftest import SF


def test_constant_folding(spark):
    df = spark.range(10).selectExpr("1 + 2 * 3 + id AS folded")
    assert "(id" in inspect.optimized_plan(df) and "+ 7)" in inspect.optimized_plan(df)
    assert [r[0] for r in df.collect()] == list(range(7, 17))


def test_no_folding_in_a_udf(spark):
    plus = F.udf(lambda x: 1 + 2 * 3 + x, "bigint")
    assert "+ 7)" not in inspect.optimized_plan(spark.range(10).select(plus("id")))


def test_pushdown(spark):
    e = table(spark, SF, "events")
    column = e.filter(F.col("event_id") > 5).select("event_id")
    assert "GreaterThan(event_id,5)" in inspect.pushed_filters(column)[0]
    assert inspect.read_columns(column) == ["event_id:bigint"]
    opaque = e.filter(F.udf(lambda x: x > 5, "boolean")("event_id")).select("event_id")
    assert inspect.pushed_filters(opaque) == [""]
    assert column.count() == opaque.count()


def test_cache_is_used(spark):
    df = spark.range(5).persist(StorageLevel.MEMORY_ONLY)
    df.count()
    assert "InMemoryRelation" in inspect.plan_text(df)
    df.unpersist()


def test_expressions(spark):
    assert inspect.expression_text(F.col("a") + 1) == "+(a, 1)"
    assert inspect.evaluate(spark, F.lit(1)) == 1
    n, text = inspect.lineage(spark.range(0, 10, 1, 3))
    assert n == 3 and "RDD" in text
    assert inspect.settings(spark)["version"] == spark.version


def test_missing_column_fails_at_once(spark):
    with pytest.raises(AnalysisException):
        table(spark, SF, "nation").filter(F.col("n_name1") == "x")


def test_strict_union_fails(spark):
    a, b = spark.sql("SELECT 1 AS col0, 2 AS col1"), spark.sql("SELECT 4 AS col11, 5 AS col00")
    with pytest.raises(AnalysisException):
        a.unionByName(b)
    assert len(a.unionByName(b, allowMissingColumns=True).columns) == 4 and a.union(b).columns == ["col0", "col1"]


def test_explode_drops_empty(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x", "y"]), (3, []), (4, None)], "id int, arr array<string>")
    assert df.select("id", F.explode("arr")).count() == 5
    words = spark.createDataFrame([("a  b",), ("",), (None,)], "t string").select(F.explode(F.split("t", " ")).alias("w"))
    assert [r[0] for r in words.collect()] == ["a", "", "b", ""]


def test_map_groups(spark):
    squares = spark.range(1, 10, 1, 3).select((F.col("id") * F.col("id")).alias("value")).repartition(2)
    lists = squares.groupBy((F.col("value") % 2).alias("k")).agg(F.collect_list("value").alias("v")).collect()
    assert {r["k"]: sorted(r["v"]) for r in lists} == {0: [4, 16, 36, 64], 1: [1, 9, 25, 49, 81]}


def test_order(spark):
    rows = QUERIES["order_multi"](spark, SF).collect()
    keys = [(r["s_nationkey"], -r["s_acctbal"]) for r in rows]
    assert keys == sorted(keys)
