from __future__ import annotations

import pytest

from tripstrata import constants as C
from tripstrata.operators import adhoc


@pytest.mark.parametrize(
    "text, reason",
    [
        ("", C.SQL_EMPTY),
        (" \n\t", C.SQL_EMPTY),
        ("select 1", None),
        ("SELECT 1;", None),
        ("  -- note\n/* more */ With x as (select 1) select * from x", None),
        ("delete from t", C.SQL_NOT_SELECT),
        ("-- select 1", C.SQL_NOT_SELECT),
        ("/* open select 1", C.SQL_NOT_SELECT),
        ("explain select 1", C.SQL_NOT_SELECT),
        (";", C.SQL_NOT_SELECT),
        ("select 1; select 2", C.SQL_MANY_STATEMENTS),
        ("select ';' as x", C.SQL_MANY_STATEMENTS),
        ("select 1; -- done", C.SQL_MANY_STATEMENTS),
        ("select 1 ; ; ", None),
    ],
)
def test_guard(text, reason):
    assert adhoc.sql_guard(text) == reason


@pytest.fixture(scope="module")
def shop(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.range(600).selectExpr("id", "id * 2 AS `Mixed Case`").write.mode("overwrite").saveAsTable("shop.items")
    return "shop"


@pytest.mark.parametrize(
    "text",
    [
        "WITH x AS (SELECT 1 AS id, 2 AS m) INSERT INTO shop.items SELECT * FROM x",
        "select 1) x, (select 2",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "select `java_method`('java.lang.Math', 'random')",
        "SELECT TRANSFORM (id) USING 'cat' FROM shop.items",
        "SELECT TRANSFORM (id) USING /* c */ \"cat\" FROM shop.items",
        "SELECT IDENTIFIER('reflect')('java.lang.Math','max',1,2)",
        "SELECT IDENTIFIER('ref' || 'lect')('java.lang.Math','max',1,2)",
        "SELECT try_reflect('java.lang.Math','max',1,2)",
        "SELECT 1 WHERE EXISTS (SELECT reflect('java.lang.Math','max',1,2))",
        "SELECT TRANSFORM(a) USING r'cat' AS (b) FROM VALUES (1) t(a)",
        "SELECT * FROM (SELECT TRANSFORM(a) USING 'cat' AS (b) FROM VALUES (1) t(a))",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT (SELECT count(*) FROM text.`/etc/hostname`)",
        "select * from shop.missing",
        "select id from",
    ],
)
def test_refused_or_failed_queries_return_an_error(spark, shop, text):
    result = adhoc.run_sql(spark, text)
    assert result.error and result.rows == []
    assert spark.table("shop.items").count() == 600


def test_words_in_literals_are_not_code(spark, shop):
    result = adhoc.run_sql(spark, "select 'reflect(x) using ''y''' as text, count(*) from shop.items a join shop.items b using (id)")
    assert result.error is None and result.rows[0][1] == 600


def test_row_limit(spark, shop):
    result = adhoc.run_sql(spark, "select id from shop.items order by id;")
    assert (result.columns, result.row_count, result.truncated, result.error) == (["id"], 500, True, None)
    assert [row[0] for row in result.rows] == list(range(500))
    exact = adhoc.run_sql(spark, "select id from shop.items where id < 500")
    assert (exact.row_count, exact.truncated) == (500, False)
    assert exact.duration_ms >= 0


def test_timeout(spark):
    slow = "select count(*) from range(100000000000) where sha2(cast(id as string), 512) like 'zz%'"
    result = adhoc.run_sql(spark, slow, timeout_s=3)
    assert result.error == "query timed out after 3s"
    assert result.duration_ms < 60_000
    assert adhoc.run_sql(spark, "select 1").rows == [[1]]


def test_catalog(spark, shop):
    spark.sql("CREATE DATABASE IF NOT EXISTS books")
    spark.range(1).write.mode("overwrite").saveAsTable("books.hidden_log")
    spark.range(1).selectExpr("id", "'x' AS title").write.mode("overwrite").saveAsTable("books.titles")
    rows = [tuple(r) for r in adhoc.catalog(spark, ["shop", "books", "nowhere"], hidden=("books.hidden_log",)).collect()]
    assert rows == [
        ("books", "titles", 1, "id", "bigint"),
        ("books", "titles", 2, "title", "string"),
        ("shop", "items", 1, "id", "bigint"),
        ("shop", "items", 2, "Mixed Case", "bigint"),
    ]
    assert adhoc.catalog(spark, ["nowhere"]).count() == 0


def test_preview(spark, shop):
    preview = adhoc.table_preview(spark, "shop", "items")
    assert (preview.row_count, preview.row_count_error, preview.sample.row_count) == (600, None, 20)
    missing = adhoc.table_preview(spark, "shop", "no`table")
    assert missing.row_count is None and missing.sample is None
    assert missing.row_count_error and missing.sample_error


def test_guard_of_a_column_agrees(spark):
    texts = [
        None, "", " \n\t\x0b\x1c ", "select 1", "SELECT 1;", "  -- note\n/* more */ With x as (select 1) select * from x",
        "delete from t", "-- select 1", "/* open select 1", "explain select 1", ";", " ; ;", "select 1; select 2",
        "select ';' as x", "select 1; -- done", "select 1 ; ; ", "--a\n--b\r\nselect 1", "/**//* */select 1", " select 1",
        "-- " * 5_000 + "\nselect 1", "(select 1)", "values (1)", "/* -- */ select 1 /* ; */",
    ]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = {r["n"]: r["reason"] for r in df.withColumn("reason", adhoc.guard_reason("t")).collect()}
    assert got == {n: adhoc.sql_guard(t or "") for n, t in enumerate(texts)}
