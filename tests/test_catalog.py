"""Every query of the core against its SQL on the smallest tables."""

import pytest

from cairnstat.plans import catalog

from compare import connection, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, con, name):
    cols, rows = spark_rows(catalog.QUERIES[name](spark, small))
    expected_cols, expected = sql_rows(con, catalog.SQL[name])
    assert cols == expected_cols
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_flagship(spark, small):
    assert catalog.flagship(spark, small).count() == 6


def test_bijection_covers_every_run(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "item_id string").write.parquet(f"{tmp_path}/interim_item.parquet")
    done = [(1, "r0", "m", "a"), (2, "r0", "m", "b"), (3, "r1", "m", "a"), (3, "r1", "m", "a"), (4, "r2", "m", "a"), (5, "r2", "m", "a"), (6, "r2", "m", "b"), (7, "r2", "m", "x")]
    spark.createDataFrame(done, "record_id long, run_id string, model_key string, item_id string").write.parquet(f"{tmp_path}/baseline_record.parquet")
    got = sorted(map(tuple, catalog.QUERIES["q66_bijection_runs"](spark, str(tmp_path)).collect()))
    assert got == [("r1", "m", "b", 1, 0), ("r2", "m", "a", 1, 2), ("r2", "m", "x", 0, 1)]


def test_block_gaps_covers_the_whole_table(spark, tmp_path):
    """The artificial gap: birch lacks its block 1; cedar is whole."""
    rows = [("cedar", 0), ("cedar", 1), ("cedar", 2), ("birch", 0), ("birch", 2), ("birch", 2), ("birch", None)]
    spark.createDataFrame(rows, "model_key string, block_no int").write.parquet(f"{tmp_path}/margin_score.parquet")
    got = sorted(map(tuple, catalog.QUERIES["q67_block_gaps_all"](spark, str(tmp_path)).collect()))
    assert got == [("birch", 2, 1)]
