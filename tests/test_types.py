import pytest
from pyspark.sql import types as T

from millrace import types
from millrace.plans.codegen import bundle


@pytest.mark.parametrize(
    ("name", "dialect", "want"),
    [
        ("NUMERIC(10,2)", "postgresql", T.DecimalType(10, 2)),
        ("NUMERIC", "postgresql", T.DecimalType(38, 0)),
        ("varchar(255)", "postgresql", T.StringType()),
        ("timestamp(6) without time zone", "postgresql", T.TimestampType()),
        ("DOUBLE PRECISION", "postgresql", T.DoubleType()),
        ("BYTEA", "postgresql", T.BinaryType()),
        ("POINT", "postgresql", T.StringType()),
        ("INTERVAL", "postgresql", T.StringType()),
        ("TINYINT(1)", "mysql", T.ByteType()),
        ("DATETIME", "mysql", T.TimestampType()),
        ("NUMBER", "oracle", T.DecimalType(38, 18)),
        ("NUMBER(9)", "oracle", T.IntegerType()),
        ("NUMBER(10)", "oracle", T.LongType()),
        ("NUMBER(18,0)", "oracle", T.LongType()),
        ("NUMBER(19,0)", "oracle", T.DecimalType(19, 0)),
        ("NUMBER(38)", "oracle", T.DecimalType(38, 0)),
        ("NUMBER(7,-3)", "oracle", T.LongType()),
        ("NUMBER(2,5)", "oracle", T.DecimalType(5, 5)),
        ("NUMBER(12,3)", "oracle", T.DecimalType(12, 3)),
        ("DATE", "oracle", T.TimestampType()),
        ("RAW(16)", "oracle", T.BinaryType()),
    ],
)
def test_spark_types(name, dialect, want):
    assert types.spark_type(name, dialect) == want


def test_records_and_names():
    assert types.infer_types({"id": 1, "name": "alice", "active": True}) == {"id": "int", "name": "str", "active": "bool"}
    assert types.sql_types({"id": "int", "value": "float", "x": "str"}) == {"id": "INTEGER", "value": "FLOAT", "x": "STRING"}
    assert bundle({"id": "INTEGER"}, {"steps": ["read", "write"]}) == {"schema": {"id": "INTEGER"}, "config": {"steps": ["read", "write"]}}


def test_ddl(spark):
    table = types.Table("orders", [types.Column("id", "BIGINT", False), types.Column("total", "NUMERIC(10,2)"), types.Column("created_at", "TIMESTAMP")], ["id"])
    ddl = types.create_table(table)
    assert "PARTITIONED BY (`created_at_year`)" in ddl and "`total` DECIMAL(10,2)" in ddl
    spark.sql("DROP TABLE IF EXISTS orders")
    spark.sql(ddl)
    assert spark.table("orders").columns == ["id", "total", "created_at", "created_at_year"]
    spark.sql("DROP TABLE orders")
    assert table.struct()["id"].metadata == {"primary_key": True}
    assert types.create_jdbc_table("t", table.struct(), ["id"]) == "CREATE TABLE t (id BIGINT NOT NULL, total DECIMAL(10,2), created_at TIMESTAMP, PRIMARY KEY (id))"


def test_drivers_and_schemas():
    assert types.driver_of("jdbc:mysql://h/db") == "com.mysql.cj.jdbc.Driver"
    assert types.driver_of("mssql://h") == types.driver_of("jdbc:sqlserver://h")
    with pytest.raises(ValueError):
        types.driver_of("jdbc:nothing://h")
    assert types.schema_of({"a": "int", "b": "str", "c": "timestamp"}).simpleString() == "struct<a:int,b:string,c:timestamp>"
