import pytest
from oracle import compare

from tidewell.plans import registered

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["union_all", "union_distinct", "intersect", "intersect_all", "except", "except_all"])
def test_sets_of_whole_tables(spark, name):
    name = f"set_{name}"
    n = compare(spark, registered.queries[name], registered.oracle_sql[name], SF)
    customers, suppliers = (registered.read(spark, SF, t).count() for t in ("customer", "supplier"))
    assert name != "set_union_all" or n == customers + suppliers
    assert name != "set_except" or n == customers - suppliers
    assert name != "set_except_all" or n == customers - suppliers


def test_sort_of_the_whole_log(spark):
    events = registered.read(spark, SF, "events").count()
    assert compare(spark, registered.queries["lsn_sort"], registered.oracle_sql["lsn_sort"], SF) == events
    assert [r.place for r in registered.queries["lsn_sort"](spark, SF).collect()] == list(range(1, events + 1))


def test_full_join_has_unmatched_rows_of_both_sides(spark):
    compare(spark, registered.queries["join_full"], registered.oracle_sql["join_full"], SF)
    rows = registered.queries["join_full"](spark, SF).collect()
    assert any(r.c_custkey is None for r in rows) and any(r.s_suppkey is None for r in rows)
    assert any(None not in (r.c_custkey, r.s_suppkey) for r in rows)
    assert {r.c_custkey for r in rows} - {None} == {r.c_custkey for r in registered.read(spark, SF, "customer").collect()}


@pytest.mark.parametrize("name", ["join_anti", "predicates", "join_using", "join_natural", "window_last_value", "more_strings", "more_maths"])
def test_rows_come_back(spark, name):
    assert compare(spark, registered.queries[name], registered.oracle_sql[name], SF) > 0
