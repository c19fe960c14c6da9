"""Queries of the eight problems on the smallest tables, against their SQL where they have one."""

import pytest

from cairnstat.llm import catalog

from compare import connection, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    cols, rows = spark_rows(catalog.queries()[name](spark, small))
    expected_cols, expected = sql_rows(connection(small), catalog.oracle_sql()[name])
    assert cols == expected_cols and rows == expected


FOUND = {
    "p1_found": [("source_a", "string"), ("source_b", "string")], "p2_found": [("record_id", "bigint")], "p3_found": [("record_id", "bigint"), ("entity_id", "bigint")], "p4_found": [("freeze_id", "bigint")],
    "p5_found": [("record_id", "bigint"), ("field", "string")], "p8_found": [("doc_id", "bigint"), ("seg_no", "int"), ("lang", "string")],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_has_exactly_its_columns(spark, small, name):
    df = catalog.queries()[name](spark, small)
    assert df.dtypes == FOUND[name]
    rows = df.collect()
    assert len(rows) == len(set(rows)) and rows


@pytest.mark.parametrize("name", ["p6_pack", "p6_fill", "p7_mix", "p7_shares", "p3_links", "p5_forms", "p8_segments", "p2_rates", "p1_ranking"])
def test_other_queries_give_rows(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_hazards_show_both_scopes_all_units_and_the_walls(spark, small):
    got = catalog.queries()["p2_hazards_all"](spark, small)
    assert {(r.scope, r.unit) for r in got.select("scope", "unit").distinct().collect()} == {(s, u) for s in ("run", "limit") for u in ("pieces", "chars", "bytes")}
    assert got.where("significant and p_value < 0.01").count() > 0
    part = got.where("scope = 'run' and unit <> 'pieces'")
    narrow = catalog.queries()["p2_hazards"](spark, small)
    assert part.select(*narrow.columns).exceptAll(narrow).count() == 0 and part.count() == narrow.count()
