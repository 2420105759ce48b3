"""The catalogue: a query for each operator over the generated tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.schema import VARIANT, conform, require_non_null, to_variant
from tidemark.operators import cdc
from tidemark.operators.table import VersionedTable
from tidemark.session import shared_dir
from tidemark.sources import drip, readers
from tidemark.streaming import sinks, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that DuckDB runs on the same tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# -- filters and projections --


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def filter_or_project(spark, d):
    o = table(spark, d, "orders")
    return o.filter((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def filter_opaque_udf(spark, d):
    """A predicate the optimizer cannot see into: nothing is pushed down, the column crosses to Python in Arrow batches."""

    @F.pandas_udf("boolean")
    def third(keys):
        return keys % 3 == 1

    return table(spark, d, "orders").filter(third("o_orderkey")).select("o_orderkey")


@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase') AND NOT (value IS NULL) AND value IS NOT NULL")
def filter_in_null_not(spark, d):
    e = table(spark, d, "events")
    return e.filter(F.col("event_type").isin("click", "purchase") & ~F.col("value").isNull() & F.col("value").isNotNull()).select("event_id", "event_type", "value")


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 2 = 0 AND p_brand <> 'x'")
def filter_sql_string(spark, d):
    return table(spark, d, "part").filter("p_size % 2 = 0 AND p_brand <> 'x'").select("p_partkey", "p_size")


@query("SELECT event_id, user_id, event_type, value FROM events")
def assert_not_null(spark, d):
    schema = T.StructType([T.StructField("event_id", T.LongType(), False), T.StructField("user_id", T.LongType(), False), T.StructField("event_type", T.StringType(), False), T.StructField("value", T.DoubleType(), False)])
    return require_non_null(conform(table(spark, d, "events"), schema), schema)


@query("SELECT event_id, event_type = 'click' AS is_click FROM events WHERE (event_type = 'click') = false")
def filter_boolean_column(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "click").alias("is_click"))
    return e.filter(F.col("is_click") == F.lit(False))


@query("SELECT 1 + 2 * 3 + o_orderkey AS folded FROM orders")
def select_expr_folding(spark, d):
    return table(spark, d, "orders").selectExpr("1 + 2 * 3 + o_orderkey AS folded")


@query("SELECT *, 1 AS one FROM nation")
def star_plus_literal(spark, d):
    return table(spark, d, "nation").select("*", F.lit(1).alias("one"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def rename_drop(spark, d):
    return table(spark, d, "nation").withColumnRenamed("n_name", "name").drop("n_regionkey").toDF("id", "name")


@query("SELECT r_regionkey AS key, r_name AS label FROM region")
def positional_rename(spark, d):
    return table(spark, d, "region").toDF("key", "label")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def struct_pack_unpack(spark, d):
    return table(spark, d, "customer").select(F.struct("*").alias("entity")).select("entity.*")


@query("SELECT p_partkey AS id, p_size AS x, p_size + 1 AS y FROM part")
def tuple_struct(spark, d):
    packed = table(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS x").selectExpr("(id, x) AS complex", "x + 1 AS y")
    return packed.select("complex.id", F.col("complex").getField("x").alias("x"), "y")


@query("SELECT c_custkey AS \"@id\", c_name AS name FROM customer")
def quoted_paths(spark, d):
    c = table(spark, d, "customer").select(F.struct(F.col("c_custkey").alias("@id"), F.col("c_name").alias("name")).alias("entity"))
    return c.select(F.col("entity.`@id`").alias("@id"), F.col("entity.`name`").alias("name"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS from_map, event_type AS first_tag FROM events")
def nested_access(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"), F.array("event_type", F.lit("x")).alias("tags"))
    return e.select("event_id", F.col("m")["k"].alias("from_map"), F.col("tags")[0].alias("first_tag"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = l_linestatus AS sameness FROM lineitem")
def sameness_flag(spark, d):
    return table(spark, d, "lineitem").withColumn("sameness", F.expr("l_returnflag == l_linestatus")).select("l_orderkey", "l_linenumber", "sameness")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN concat('Debt. ', c_name) ELSE c_name END AS title, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def case_when_concat_cast(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", F.when(F.col("c_acctbal") < 0, F.concat(F.lit("Debt. "), F.col("c_name"))).otherwise(F.col("c_name")).alias("title"), F.col("c_nationkey").cast("string").alias("nation"))


@query("SELECT p_partkey, p_size + 1 AS a, p_size + 1 AS b, p_size + 1 AS c FROM part")
def reference_forms(spark, d):
    """A column by function, by text and by frame are the same column."""
    p = table(spark, d, "part")
    return p.select("p_partkey", (F.col("p_size") + 1).alias("a"), F.expr("p_size + 1").alias("b"), (p["p_size"] + 1).alias("c"))


@query("SELECT p_partkey * p_partkey AS value FROM part")
def map_values(spark, d):
    """One output per row: a column expression where the closure can be said as one."""
    return table(spark, d, "part").select((F.col("p_partkey") * F.col("p_partkey")).alias("value"))


@query("SELECT * FROM (VALUES ('u1', 'c1', 'i1'), ('u1', 'c1', 'i2'), ('u2', 'c2', 'i1')) AS t(\"userId\", \"cartId\", \"itemId\")")
def local_rows(spark, d):
    schema = T.StructType([T.StructField(c, T.StringType(), False) for c in ("userId", "cartId", "itemId")])
    return spark.createDataFrame([("u1", "c1", "i1"), ("u1", "c1", "i2"), ("u2", "c2", "i1")], schema)


@query("SELECT r_regionkey, r_name FROM region WHERE false")
def empty_frame(spark, d):
    return readers.empty(spark, table(spark, d, "region").schema)


@query("SELECT range AS id, range % 3 AS part FROM range(1, 10)")
def fixed_partitions(spark, d):
    return spark.range(1, 10, 1, 3).repartition(2).coalesce(1).select("id", (F.col("id") % 3).alias("part"))


# -- arrays, JSON, XML --


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def split_explode(spark, d):
    return table(spark, d, "part").withColumn("words", F.split("p_name", " ")).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, unnest(coalesce(string_split(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END, ' '), [''])) AS word FROM part")
def flatmap_default(spark, d):
    name = F.when(F.col("p_size") % 5 == 0, F.lit(None)).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.explode(F.coalesce(F.split(name, " "), F.array(F.lit("")))).alias("word"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse_unpack(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint", {"mode": "FAILFAST"}).alias("p")).select("event_id", "p.*")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_render_roundtrip(spark, d):
    n = table(spark, d, "nation")
    lines = n.select(F.to_json(F.struct("*")).alias("value"))
    return readers.parse_json(lines, n.schema)


@query("""SELECT r_regionkey, concat('<Region>', chr(10), '    <r_regionkey>', r_regionkey, '</r_regionkey>', chr(10), '    <r_name>', r_name, '</r_name>', chr(10), '</Region>') AS xml FROM region""")
def xml_render(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.to_xml(F.struct("*"), {"rowTag": "Region"}).alias("xml"))


@query("""SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey
          HAVING count(*) > 0 AND bool_or(c_acctbal > 9000) AND min_by(c_acctbal, c_custkey) > 100""")
def exists_size(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("held"))
    rich = (F.size("held") > 0) & F.exists("held", lambda x: x["c_acctbal"] > 9000) & (F.col("held")[0]["c_acctbal"] > 100)
    return c.filter(rich).select("c_nationkey", F.size("held").cast("bigint").alias("n"))


# -- aggregates, sets, order --


@query("SELECT l_orderkey % 2 AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey % 2")
def group_key_count(spark, d):
    return table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 2).alias("key")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey, array_to_string(list_sort(list(c_custkey)), ',') AS members FROM customer GROUP BY c_nationkey")
def group_members(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list("c_custkey")), ",").alias("members"))


@query("""SELECT c_nationkey, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY c_nationkey""")
def map_groups(spark, d):
    """One output per group by a function over the whole group; groups here are nations, bounded by the key's table."""

    def summary(key, rows):
        import pandas as pd

        return pd.DataFrame([(key[0], len(rows), int(rows["c_custkey"].sum()))], columns=["c_nationkey", "n", "keys"])

    return table(spark, d, "customer").select("c_nationkey", "c_custkey").groupBy("c_nationkey").applyInPandas(summary, "c_nationkey int, n bigint, keys bigint")


@query("SELECT n_regionkey, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY n_regionkey")
def nested_rows(spark, d):
    """Whole rows nested under their key, and read again."""
    nested = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("*")).alias("rows"))
    return nested.select("n_regionkey", F.size("rows").cast("bigint").alias("n"), F.array_min(F.transform("rows", lambda r: r["n_name"])).alias("first_name"))


@query("SELECT DISTINCT event_type, user_id % 10 AS bucket FROM events")
def distinct_rows(spark, d):
    return table(spark, d, "events").select("event_type", (F.col("user_id") % 10).alias("bucket")).distinct()


@query("SELECT count(DISTINCT user_id) AS users FROM events")
def count_distinct(spark, d):
    return table(spark, d, "events").select("user_id").distinct().agg(F.count("user_id").alias("users"))


@query("SELECT round(avg(value), 6) AS mean, CAST(sum(event_id) AS BIGINT) AS total FROM events")
def global_avg(spark, d):
    return table(spark, d, "events").select(F.round(F.avg("value"), 6).alias("mean"), F.expr("sum(event_id)").alias("total"))


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC")
def order_multi(spark, d):
    return table(spark, d, "supplier").orderBy(F.col("s_nationkey").asc(), F.col("s_acctbal").desc()).select("s_suppkey", "s_nationkey", "s_acctbal")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def drop_duplicates(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").dropDuplicates()


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL BY NAME SELECT s_name AS name, s_suppkey AS key FROM supplier")
def union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")))


@query("SELECT r_regionkey AS key, r_name AS region FROM region UNION ALL BY NAME SELECT n_nationkey AS key, n_name AS nation FROM nation")
def union_missing(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("region"))
    return r.unionByName(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("nation")), allowMissingColumns=True)


@query("SELECT r_regionkey AS a, r_name AS b FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def union_positional(spark, d):
    return table(spark, d, "region").toDF("a", "b").union(table(spark, d, "nation").select("n_nationkey", "n_name"))


_PERSON = T.StructType([T.StructField("name", T.StringType(), False), T.StructField("balance", T.DoubleType(), True), T.StructField("segment", T.StringType(), True), T.StructField(VARIANT, T.StringType(), False)])


@query("""SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'Customer' AS _type FROM customer
          UNION ALL SELECT s_name, s_acctbal, NULL, 'Supplier' FROM supplier""")
def variant_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return to_variant(c, "Customer", _PERSON).unionByName(to_variant(s, "Supplier", _PERSON))


@query("SELECT CAST(row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) - 1 AS BIGINT) AS place, s_suppkey FROM supplier")
def order_places(spark, d):
    """Rows numbered in the order that a sort gave them; the numbers say what an order-free comparison cannot see."""
    ordered = table(spark, d, "supplier").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey").select("s_suppkey")
    return ordered.coalesce(1).select(F.monotonically_increasing_id().alias("place"), "s_suppkey")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events)")
def distinct_count_action(spark, d):
    """An action: the number comes to the driver."""
    return spark.createDataFrame([(table(spark, d, "events").select("event_type", "user_id").distinct().count(),)], "n bigint")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def lineitem_summary(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


# -- sources and sinks: round trips --


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_read(spark, d):
    n, path = table(spark, d, "nation"), _folder(spark, "csv")
    n.write.option("header", True).csv(path)
    inferred = readers.read_csv(spark, path)
    return conform(readers.read_csv(spark, path, n.schema).intersect(conform(inferred, n.schema)), n.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_read(spark, d):
    n, path = table(spark, d, "nation"), _folder(spark, "json")
    readers.write_json(n, path)
    return readers.read_json(spark, path, n.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def text_read(spark, d):
    n, path = table(spark, d, "nation"), _folder(spark, "text")
    n.select(F.to_json(F.struct("*"))).write.text(path)
    return readers.parse_json(readers.read_lines(spark, path), n.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_infer(spark, d):
    """Schema from the data: numbers come as long, columns in the order of their names."""
    n, path = table(spark, d, "nation"), _folder(spark, "json")
    readers.write_json(n, path)
    return conform(readers.read_json(spark, path), n.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_strings(spark, d):
    n = table(spark, d, "nation")
    return readers.read_json_strings(n.select(F.to_json(F.struct("*")).alias("value")), n.schema)


@query("SELECT CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey END AS n_nationkey, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS n_name FROM nation")
def json_permissive(spark, d):
    """Malformed lines keep their row and lose their fields."""
    n, path = table(spark, d, "nation").select("n_nationkey", "n_name"), _folder(spark, "lines")
    n.select(F.when(F.col("n_nationkey") % 5 == 0, F.lit("{oops")).otherwise(F.to_json(F.struct("*"))).alias("value")).write.text(path)
    return readers.read_json(spark, path, n.schema, readers.PERMISSIVE)


@query("SELECT range AS id FROM range(0, 1000)")
def range_ids(spark, d):
    return spark.range(1000)


# -- versioned table --

_CUSTOMER = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), True), T.StructField("nation", T.IntegerType(), True)])


def _customers(spark: SparkSession, d: str) -> tuple[VersionedTable, DataFrame]:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    made = VersionedTable.create(spark, _folder(spark, "table"), _CUSTOMER)
    made.write(rows, "append")
    return made, rows


def _incoming(rows: DataFrame) -> DataFrame:
    """Every third customer under a new name, and as many new ones."""
    some = rows.filter("id % 3 = 0")
    renamed = some.select("id", F.concat(F.lit("Dr. "), F.col("name")).alias("name"), "nation")
    return renamed.union(some.select((F.col("id") + 1_000_000).alias("id"), F.concat(F.lit("New "), F.col("name")).alias("name"), "nation"))


_BASE = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer"
_RENAMED = "SELECT c_custkey AS id, concat('Dr. ', c_name) AS name, c_nationkey AS nation FROM customer WHERE c_custkey % 3 = 0"
_NEW = "SELECT c_custkey + 1000000 AS id, concat('New ', c_name) AS name, c_nationkey AS nation FROM customer WHERE c_custkey % 3 = 0"


@query(f"SELECT * FROM ({_BASE}) WHERE NOT (nation = 3)")
def table_delete(spark, d):
    made, _ = _customers(spark, d)
    made.delete("nation = 3")
    return made.snapshot()


@query(f"SELECT * FROM ({_BASE}) WHERE nation <> 3 AND id % 5 <> 0")
def table_delete_column(spark, d):
    made, _ = _customers(spark, d)
    made.delete((F.col("nation") == 3) | (F.col("id") % 5 == 0))
    return made.snapshot()


@query(f"SELECT count(*) AS n, CAST(1 AS BIGINT) AS version, true AS rejected FROM ({_BASE})")
def table_merge_conflict(spark, d):
    """Two source rows for one row of the table: the merge is refused and the table stays as it was."""
    made, rows = _customers(spark, d)
    rejected = False
    try:
        cdc.upsert(made, rows.filter("id % 3 = 0").unionByName(rows.filter("id % 6 = 0")), "id")
    except ValueError:
        rejected = True
    return made.snapshot().agg(F.count("*").alias("n")).select("n", F.lit(made.version()).cast("bigint").alias("version"), F.lit(rejected).alias("rejected"))


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN concat('Dr. ', name) ELSE name END AS name, nation FROM ({_BASE})")
def table_update(spark, d):
    made, _ = _customers(spark, d)
    made.update("id % 2 = 0", {"name": F.concat(F.lit("Dr. "), F.col("name"))})
    return made.snapshot()


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey AS nation FROM nation")
def table_overwrite(spark, d):
    made, _ = _customers(spark, d)
    made.write(table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("nation")), "overwrite")
    return made.snapshot()


@query(f"SELECT * FROM ({_BASE}) WHERE id % 3 <> 0 UNION ALL ({_RENAMED}) UNION ALL ({_NEW})")
def table_upsert(spark, d):
    made, rows = _customers(spark, d)
    cdc.upsert(made, _incoming(rows), "id")
    return made.snapshot()


@query(f"SELECT * FROM ({_BASE}) WHERE id % 3 <> 0 UNION ALL ({_RENAMED})")
def table_update_only(spark, d):
    made, rows = _customers(spark, d)
    cdc.update_only(made, _incoming(rows), "id")
    return made.snapshot()


@query(f"SELECT * FROM ({_BASE}) WHERE id % 3 <> 0 AND id % 7 <> 0 UNION ALL SELECT * FROM ({_RENAMED}) WHERE id % 7 <> 0 UNION ALL SELECT * FROM ({_NEW})")
def table_upsert_tombstone(spark, d):
    made, rows = _customers(spark, d)
    gone = rows.filter("id % 7 = 0").select("id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("nation"))
    absent = gone.select((F.col("id") + 9_000_000).alias("id"), "name", "nation")
    cdc.upsert_with_tombstones(made, _incoming(rows).filter("id % 7 <> 0 OR id > 1000000").unionByName(gone).unionByName(absent), "id")
    return made.snapshot()


def _log(rows: DataFrame) -> DataFrame:
    entity = F.struct("id", "name", "nation")
    upserts = _incoming(rows).filter("id % 7 <> 0 OR id > 1000000").select(F.col("id").alias("key"), entity.alias("entity"), F.lit(1).cast("bigint").alias("offset"), F.lit(cdc.UPSERT).alias("_type"))
    gone = rows.filter("id % 7 = 0").select(F.col("id").alias("key"), F.when(F.lit(False), entity).alias("entity"), F.lit(2).cast("bigint").alias("offset"), F.lit(cdc.TOMBSTONE).alias("_type"))
    return upserts.unionByName(gone)


@query(ORACLE_SQL["table_upsert_tombstone"])
def table_upsert_log(spark, d):
    made, rows = _customers(spark, d)
    cdc.upsert_log(made, _log(rows), "id")
    return made.snapshot()


@query(f"SELECT 2 AS version, CAST(1 AS BIGINT) AS has_feed, (SELECT count(*) FROM ({_BASE})) AS n_rows")
def table_detail(spark, d):
    made, _ = _customers(spark, d)
    made.delete("id < 0")
    made.checkpoint()
    count = VersionedTable(spark, made.path).snapshot().agg(F.count("*").alias("n_rows"))
    return made.detail().select(F.col("version").cast("int").alias("version"), F.array_contains("table_features", "changeDataFeed").cast("bigint").alias("has_feed")).crossJoin(count)  # one row each


def _changed(spark: SparkSession, d: str) -> VersionedTable:
    """Load, delete a nation, rename even ids."""
    made, _ = _customers(spark, d)
    made.delete("nation = 3")
    made.update("id % 2 = 0", {"name": F.concat(F.lit("Dr. "), F.col("name"))})
    return made


_IMAGES = f"""
    SELECT *, 'insert' AS t, 1 AS v FROM ({_BASE})
    UNION ALL SELECT *, 'delete', 2 FROM ({_BASE}) WHERE nation = 3
    UNION ALL SELECT *, 'update_preimage', 3 FROM ({_BASE}) WHERE nation <> 3 AND id % 2 = 0
    UNION ALL SELECT id, concat('Dr. ', name), nation, 'update_postimage', 3 FROM ({_BASE}) WHERE nation <> 3 AND id % 2 = 0"""
_ROW_CHANGES = f"SELECT id, name, nation, CAST(v AS BIGINT) AS version, CASE WHEN t IN ('insert', 'update_postimage') THEN 'Add' ELSE 'Remove' END AS _type FROM ({_IMAGES})"


@query(f"SELECT id, name, nation, t AS \"changeType\", CAST(v AS BIGINT) AS \"commitVersion\" FROM ({_IMAGES})")
def change_feed_raw(spark, d):
    return cdc.raw_changes(_changed(spark, d).changes(0)).select("entity.*", "changeType", "commitVersion")


@query(f"SELECT id, name, nation, t AS \"changeType\", CAST(v AS BIGINT) AS \"commitVersion\" FROM ({_IMAGES}) WHERE v >= 2")
def change_feed_sorted(spark, d):
    return cdc.sort_raw_changes(cdc.raw_changes(_changed(spark, d).changes(2))).select("entity.*", "changeType", "commitVersion")


@query(_ROW_CHANGES)
def change_feed_row_changes(spark, d):
    return cdc.sort_row_changes(cdc.row_changes(cdc.raw_changes(_changed(spark, d).changes(0)))).select("entity.*", "version", "_type")


# -- streams --


@query(_ROW_CHANGES)
def change_feed_stream(spark, d):
    feed = cdc.row_changes(cdc.raw_changes(_changed(spark, d).stream_changes(0, per_trigger=2)))
    return sinks.drain(feed, each=lambda batch, _: cdc.sort_row_changes(batch)).select("entity.*", "version", "_type")


@query(f"SELECT * FROM ({_ROW_CHANGES}) WHERE version >= 2")
def change_feed_stream_from(spark, d):
    """The feed as a stream from a version on: earlier commits are not seen."""
    return sinks.drain(cdc.row_changes(cdc.raw_changes(_changed(spark, d).stream_changes(2)))).select("entity.*", "version", "_type")


@query("SELECT range AS value FROM range(0, 100)")
def stream_rate(spark, d):
    return sinks.drain(drip.rate(spark, 100)).select("value")


def _events(spark: SparkSession, d: str, batches: int = 3) -> DataFrame:
    return drip.replay(table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value"), "event_id", batches)


@query("SELECT event_type, count(*) AS n, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users FROM events GROUP BY event_type")
def stream_collect_update(spark, d):
    """An update-mode stream emits each changed key again; the last row of a key is its result."""
    grouped = _events(spark, d).groupBy("event_type").agg(F.collect_list("user_id").alias("users"))
    last = sinks.latest(sinks.drain(grouped, "update"), "event_type")
    return last.select("event_type", F.size("users").cast("bigint").alias("n"), F.array_join(F.sort_array(F.array_distinct("users")), ",").alias("users"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_memory_sink(spark, d):
    """An update-mode query into a memory table, read by SQL; counts only grow, so the largest is the last."""
    name = f"seen_{uuid.uuid4().hex[:12]}"
    running = sinks.to_memory(_events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), name)
    running.processAllAvailable()
    running.stop()
    return spark.sql(f"SELECT event_type, max(n) AS n FROM {name} GROUP BY event_type ORDER BY event_type")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_watermark_group(spark, d):
    """Grouping is not by event time, so the watermark drops nothing: late rows count."""
    grouped = _events(spark, d).withWatermark("ts", "100 seconds").groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.latest(sinks.drain(grouped, "update"), "event_type")


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id")
def stream_running_sum(spark, d):
    events = _events(spark, d).withColumn("milli", F.floor(F.col("value") * 1000))
    return sinks.latest(sinks.drain(stateful.running_sum(events, "user_id", "milli"), "update"), "key")


@query(ORACLE_SQL["stream_running_sum"])
def stream_running_sum_event_time(spark, d):
    """The same state under event time: the watermark lies far behind, so no row is late."""
    events = _events(spark, d).withColumn("milli", F.floor(F.col("value") * 1000))
    return sinks.latest(sinks.drain(stateful.running_sum(events, "user_id", "milli", "ts", "10000 days"), "update"), "key")


@query(ORACLE_SQL["stream_running_sum"])
def stream_running_sum_append(spark, d):
    """A query in the default mode: each batch appends the totals of its keys, the largest batch has a key's last one."""
    events = _events(spark, d).withColumn("milli", F.floor(F.col("value") * 1000))
    return sinks.latest(sinks.drain(stateful.running_sum(events, "user_id", "milli", output="Append"), "append"), "key")


_LAST_EVENT = "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"
_USER = T.StructType([T.StructField("user_id", T.LongType(), False), T.StructField("event_type", T.StringType(), True), T.StructField("event_id", T.LongType(), True)])


def _user_table(spark: SparkSession, d: str) -> VersionedTable:
    """The last event of each user, merged batch by batch."""
    made = VersionedTable.create(spark, _folder(spark, "users"), _USER)
    events = _events(spark, d).select("user_id", "event_type", "event_id")
    sinks.merge_stream(events, made, "user_id", lambda t, batch, key, txn: cdc.upsert(t, sinks.last_per_key(batch, "user_id", "event_id"), key, txn))
    return made


@query(_LAST_EVENT)
def stream_upsert_table(spark, d):
    return _user_table(spark, d).snapshot()


@query(f"SELECT event_type AS \"group\", array_to_string(list_sort(list(user_id)), ',') AS members FROM ({_LAST_EVENT}) GROUP BY event_type")
def stream_group_members(spark, d):
    """Stream, table, change feed and state together: who is in a group now, after moves between groups."""
    feed = _user_table(spark, d).stream_changes(0, per_trigger=2)
    members = stateful.group_members(cdc.row_changes(cdc.raw_changes(feed)), "event_type", "user_id")
    last = sinks.latest(sinks.drain(members, "update"), "group").filter(F.size("members") > 0)
    return last.select("group", F.array_join(F.sort_array(F.transform("members", lambda m: m["user_id"])), ",").alias("members"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_group_members(spark, sf_dir)
