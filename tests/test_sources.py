"""Readers, sinks, registries, conversion and governance on small frames."""

import datetime as dt
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.operators import convert, governance, quality, relational, schema, templates, unify
from tablewright.sources import jdbc, sample, search_index, sinks
from tablewright.sources.ingest import ingest, is_table
from tablewright.sources.registry import SourceRegistry, TableSpace, UnknownSource


def test_ingest_forms(spark):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    for data in (rows, iter(rows), pd.DataFrame(rows), pa.Table.from_pylist(rows), {"a": [1, 2], "b": ["x", None]}):
        assert ingest(spark, data).count() == 2
    assert ingest(spark, None).count() == 0 and ingest(spark, []).count() == 0
    assert ingest(spark, pd.DataFrame({"v": [1.0, None]})).filter("v is null").count() == 1
    with pytest.raises(TypeError):
        ingest(spark, 5)
    assert is_table(ingest(spark, rows), ["a"]) and not is_table(rows)


def test_jdbc_options():
    o = jdbc.jdbc_options("postgres", "db", "shop", "select * from t where a = $1 and b = $2", {"a": 5, "b": "O'Neil"})
    assert o["query"] == "select * from t where a = 5 and b = 'O''Neil'" and o["url"] == "jdbc:postgresql://db:5432/shop"
    o = jdbc.jdbc_options("mysql", "db", "shop", "select * from t where d = %s", [dt.date(2024, 1, 2)], partition=("id", 0, 100, 8))
    assert o["dbtable"] == "(select * from t where d = DATE '2024-01-02') AS q" and o["numPartitions"] == "8"
    with pytest.raises(ValueError):
        jdbc.jdbc_options("mysql", "db", "shop", "  ")
    with pytest.raises(ValueError):
        jdbc.bind("select %s", [1, 2])


def test_search_defaults():
    assert search_index.search_body("plain") == {"query": {"match": {"_all": "plain"}}}
    assert search_index.search_body('{"query": {}}') == {"query": {}}
    assert search_index.paging(None) == ("_all", None, 0)
    with pytest.raises(ValueError):
        search_index.paging({"size": "many"})


def test_sample_source_and_registry(spark):
    registry = SourceRegistry()
    registry.register("sample", lambda s: sample.read_sample(s))
    with pytest.raises(ValueError):
        registry.register("sample", lambda s: None)
    assert registry.names() == ["sample"]
    assert sorted(r["metric"] for r in registry.run(spark, "sample", "all").collect()) == [100, 150]
    with pytest.raises(KeyError):
        registry.get("other")


def test_table_space(spark):
    with TableSpace(spark) as space:
        space.register("t1", spark.range(3).toDF("k"))
        assert space.names() == ["t1"] and space.sql("select * from t1 where k > :low", {"low": 0}).count() == 2
        with pytest.raises(UnknownSource):
            space.unregister("t2")
    assert not spark.catalog.tableExists("t1")


@pytest.mark.parametrize("kind", ["csv", "parquet", "json"])
def test_export_files(spark, tmp_path, kind):
    path = sinks.export(spark.range(5), kind, str(tmp_path / kind))
    reader = spark.read.option("header", "true") if kind == "csv" else spark.read
    assert getattr(reader, kind)(path).count() == 5


def test_export_objects(spark):
    assert sinks.export(spark.range(2), "arrow").num_rows == 2
    assert len(sinks.export(spark.range(2), "pandas")) == 2
    with pytest.raises(ValueError):
        sinks.export(spark.range(2), "xlsx", "x")


def test_json_values(spark):
    df = spark.createDataFrame(
        [(Decimal("5"), Decimal("1.50"), bytearray(b"ok"), bytearray(b"\xff\x00"), dt.date(2024, 1, 2))],
        "i decimal(10,0), d decimal(10,2), b binary, x binary, day date",
    )
    assert sinks.json_rows(df).first()[0] == '{"i":5,"d":1.5,"b":"ok","x":"ff00","day":"2024-01-02"}'


def test_audit_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "ann", "read", '{"k": "ü"}')], "t timestamp, a string, x string, m string")
    for _ in range(2):
        sinks.append_audit(sinks.audit_rows(rows, F.col("t"), F.col("a"), F.col("x"), F.col("m")), path)
    back = sinks.read_audit(spark, path)
    assert back.count() == 2 and back.first()["metadata"] == '{"k": "ü"}' and back.first()["event_date"] == dt.date(2024, 1, 1)


def test_unify_keeps_values(spark):
    a = spark.createDataFrame([(1, "Alice", 30)], "user_id int, user_name string, user_age int")
    b = spark.createDataFrame([(2, "Bob", 41.5)], "id long, name string, age double")
    out = unify.unify({"a": a, "b": b}, {"a": {"user_id": "id", "user_name": "name", "user_age": "age"}})
    assert sorted(tuple(r) for r in out.collect()) == [(1, "Alice", 30.0), (2, "Bob", 41.5)]
    assert schema.common_type(schema.T.BooleanType(), schema.T.StringType()) == schema.T.StringType()


def test_convert_policies(spark):
    df = spark.createDataFrame([("1", "yes"), ("x", "maybe")], "n string, f string")
    assert [tuple(r) for r in convert.convert_columns(df, {"n": "bigint", "f": "boolean"}).collect()] == [(1, True), (None, None)]
    assert dict(convert.convert_columns(df, {"n": "bigint"}, "skip").dtypes)["n"] == "string"
    with pytest.raises(Exception, match="cannot convert"):
        convert.convert_columns(df, {"n": "bigint"}, "raise").collect()
    assert convert.conversion_kind(schema.T.StringType(), "date") == "rule"


def test_schema_tools(spark):
    assert schema.normal_names(["A b", "a-b", "##", "Ü1"]) == ["a_b", "a_b_1", "column", "1"]
    df = spark.createDataFrame([(300, "true", -5, "1.5")], "a int, b string, c int, d string")
    got = {r["column"]: r["detected_type"] for r in schema.detect_types(df).collect()}
    assert got == {"a": "uint16", "b": "bool", "c": "int8", "d": "float64"}
    tagged = schema.tag_columns(spark.createDataFrame([("x", "y")], "user_email string, note string"))
    assert tagged.schema["user_email"].metadata["sensitivity"] == "confidential"
    assert tagged.schema["note"].metadata["sensitivity"] == "internal"
    m = schema.make_mapping("s", df.schema, None, {"a": "First Col"})
    assert m.columns[0].target == "first_col" and m.summary()["total"] == 4
    assert schema.match_column("x", ["yy"], {"x": "yy"}) == "yy"


def test_joins_rename_repeated_columns(spark):
    a, b = spark.createDataFrame([(1, "p")], "id int, v string"), spark.createDataFrame([(1, "q")], "id int, v string")
    out = relational.join_tables(("a", a), ("b", b), "a.id = b.id")
    assert out.columns == ["id", "v", "id_1", "v_1"] and tuple(out.first()) == (1, "p", 1, "q")
    with pytest.raises(ValueError):
        relational.join_tables(("a", a), ("b", b), "a.id = b.id", "cross")
    with pytest.raises(ValueError):
        relational.select_columns(a, ["nope"])
    with pytest.raises(ValueError):
        relational.transform_chain(a, [{"type": "explode"}])


def test_contract(spark):
    bad = governance.Contract("", "n", "1", [governance.ContractColumn("id", "integer"), governance.ContractColumn("id", "integer")], [governance.Rule("x", "not_null")])
    assert bad.findings() == ["missing_id", "duplicate_column:id", "unknown_column:x"]
    c = governance.Contract("c", "n", "1", [governance.ContractColumn("id", "integer", False), governance.ContractColumn("name", "string", False)], [governance.Rule("name", "not_null")])
    good = spark.createDataFrame([(1, "Test"), (2, None)], "id long, name string")
    rows = governance.check_contract(good, c).orderBy("id").collect()
    assert rows[0]["_errors"] == [] and rows[1]["_errors"] == ["name:required", "name:not_null"]
    only = governance.check_contract(spark.createDataFrame([(1,)], "id long"), c).first()
    assert only["_errors"] == ["name:missing"]


def test_thresholds_and_templates(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "metric string, value double")
    assert quality.threshold_alerts(rows, [("a", "gte", 3.0)]).count() == 1
    assert set(templates.names()) == {"customer_analysis", "sales_analysis", "ab_test_analysis"}
    assert templates.TEMPLATES["sales_analysis"].check(rows) == ["sales_date", "sales_amount"]
    with pytest.raises(ValueError):
        templates.execute("sales_analysis", rows)


def test_bind_leaves_quoted_marks_alone():
    assert jdbc.bind("select '%s', %s -- %s", ["a'b"]) == "select '%s', 'a''b' -- %s"
    assert jdbc.bind("select $1, '$1', $2", [1, "x"]) == "select 1, '$1', 'x'"
    assert jdbc.bind("select %s", ["a\\"], "mysql") == "select 'a\\\\'"
