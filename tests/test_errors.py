import pytest

from tidewell.plans.service import CatalogError, EncodingError, ExecutionError, QueryService, failure, to_json
from tidewell.sources import catalogs
from tidewell.sources.tablelog import Catalog


@pytest.fixture
def service(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/lake")
    catalog.create("ns", "t", spark.range(0).schema).append(spark.range(3), None, "s")
    broken = catalog.create("ns", "broken", spark.range(0).schema)
    broken.store.create(broken._entry(1), "{")
    return QueryService(spark, catalog)


def test_a_log_that_cannot_be_read_is_upstreams_fault(service):
    for ask in (lambda: service.query("SELECT * FROM lake.ns.broken", ["ns"]), lambda: service.read_table("ns", "broken"), lambda: service.query('SELECT * FROM lake.ns."broken$snapshots"', ["ns"])):
        with pytest.raises(CatalogError) as caught:
            ask()
        assert failure(caught.value)[0] == 502
    assert service.query("SELECT count(*) AS n FROM lake.ns.t", ["ns"]) == '[{"n":3}]'
    with pytest.raises(ExecutionError):
        service.query("SELECT no_such FROM lake.ns.t", ["ns"])
    with pytest.raises(ExecutionError, match="not found"):
        service.read_table("ns", "absent")


def test_a_store_that_is_away(spark):
    with pytest.raises(CatalogError):
        QueryService(spark, Catalog(spark, "nosuch://away/lake")).list_tables(["ns"])


def test_what_json_cannot_hold(spark, monkeypatch):
    from pyspark.errors import AnalysisException

    from tidewell.plans import service as module

    def refuse(*_):
        raise AnalysisException(errorClass="CANNOT_PARSE_DATATYPE", messageParameters={"msg": "no such form"})

    monkeypatch.setattr(module.F, "to_json", refuse)
    with pytest.raises(EncodingError):
        to_json(spark.range(1))


def test_explorer_takes_the_first_foreign_key_by_name(spark):
    columns = spark.createDataFrame([("s", "t", "c", 1, "int", True), ("s", "t", "d", 2, "int", False)], "schema string, table string, column string, ordinal int, type string, nullable boolean")
    primary = columns.where("ordinal = 2").select("schema", "table", "column")
    foreign = spark.createDataFrame([("s", "t", "c", "z", "s", "a", "x"), ("s", "t", "c", "b", "s", "z", "y"), ("s", "t", "c", "b2", "s", "b", "x")], "schema string, table string, column string, constraint string, to_schema string, to_table string, to_column string")
    got = [(r.column, r.in_key, r.to_table, r.to_column) for r in catalogs.explorer(columns, primary, foreign).collect()]
    assert got == [("c", False, "z", "y"), ("d", True, None, None)]
