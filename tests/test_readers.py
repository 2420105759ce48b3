import pytest

from tidemark.session import session, with_conf
from tidemark.sources import readers

FLIGHT = "DEST_COUNTRY_NAME string, ORIGIN_COUNTRY_NAME string, count int"
GOOD = '{"ORIGIN_COUNTRY_NAME":"United States","DEST_COUNTRY_NAME":"Senegal","count":40}'


def flights(tmp_path, *lines):
    p = tmp_path / "flights.json"
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_modes(spark, tmp_path):
    bad = flights(tmp_path, GOOD, '{"ORIGIN_COUNTRY_NAME":"A","DEST_COUNTRY_NAME":"B","count":"r2d2"}')
    with pytest.raises(Exception):
        readers.read_json(spark, bad, FLIGHT, readers.FAILFAST).collect()
    assert readers.read_json(spark, bad, FLIGHT, readers.PERMISSIVE).collect()[1] == ("B", "A", None)
    assert readers.read_json(spark, bad, FLIGHT, readers.DROP).collect() == [("Senegal", "United States", 40)]
    with pytest.raises(Exception):
        readers.parse_json(readers.read_lines(spark, bad), FLIGHT).collect()


def test_null_is_not_malformed(spark, tmp_path):
    path = flights(tmp_path, GOOD, '{"ORIGIN_COUNTRY_NAME":"A","DEST_COUNTRY_NAME":null,"count":null}')
    assert readers.read_json(spark, path, FLIGHT, readers.FAILFAST).collect()[1] == (None, "A", None)
    assert readers.parse_json(readers.read_lines(spark, path), FLIGHT).collect()[1] == (None, "A", None)


def test_legacy_nullability(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("count", T.IntegerType(), False)])
    lines = readers.read_lines(spark, flights(tmp_path, '{"count":null}'))
    key = "spark__sql__legacy__respectNullabilityInTextDatasetConversion"
    assert readers.read_json_strings(lines, schema).collect() == [(None,)]
    with with_conf(spark, **{key: "true"}):
        assert readers.read_json_strings(lines, schema).collect() == [(0,)]


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,n\n"Bonaire, Sint Eustatius, and Saba",58\nx,1\n')
    inferred = readers.read_csv(spark, str(p))
    assert inferred.dtypes == [("a", "string"), ("n", "int")]
    assert readers.read_csv(spark, str(p), "a string, n bigint").first() == ("Bonaire, Sint Eustatius, and Saba", 58)


def test_small_frames(spark):
    assert readers.values(spark, [4, 2, 3]).groupBy((readers.F.col("value") % 2).alias("k")).count().orderBy("k").collect() == [(0, 2), (1, 1)]
    assert readers.empty(spark, FLIGHT).count() == 0
    assert spark.range(1, 10, 1, 3).rdd.getNumPartitions() == 3


def test_session_reuses_running(spark):
    with pytest.raises(ZeroDivisionError):
        with with_conf(spark, spark__sql__shuffle__partitions="7"):
            assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
            raise ZeroDivisionError
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert callable(session)
