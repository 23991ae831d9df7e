"""Types of databases and their Spark types, one mapper for all purposes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

_SHARED = {"SMALLINT": T.ShortType(), "BIGINT": T.LongType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "CHAR": T.StringType(), "VARCHAR": T.StringType(), "TEXT": T.StringType(), "BOOLEAN": T.BooleanType(), "JSON": T.StringType(), "INTEGER": T.IntegerType()}

# Names of database types. DECIMAL and NUMERIC take their precision and scale.
TYPES: dict[str, dict[str, T.DataType]] = {
    "postgresql": _SHARED
    | {
        "REAL": T.FloatType(),
        "DOUBLE PRECISION": T.DoubleType(),
        "TIMESTAMP WITHOUT TIME ZONE": T.TimestampType(),
        "TIMESTAMP WITH TIME ZONE": T.TimestampType(),
        "BYTEA": T.BinaryType(),
        "UUID": T.StringType(),
        "JSONB": T.StringType(),
    },
    "mysql": _SHARED | {"INT": T.IntegerType(), "TINYINT": T.ByteType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "DATETIME": T.TimestampType(), "BLOB": T.BinaryType()},
    "oracle": {"VARCHAR2": T.StringType(), "CHAR": T.StringType(), "CLOB": T.StringType(), "DATE": T.TimestampType(), "TIMESTAMP": T.TimestampType(), "BLOB": T.BinaryType(), "RAW": T.BinaryType()},
    "derby": _SHARED | {"INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "REAL": T.FloatType(), "CLOB": T.StringType(), "BLOB": T.BinaryType()},
}
DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "oracle": "oracle.jdbc.driver.OracleDriver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "db2": "com.ibm.db2.jcc.DB2Driver",
    "derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver",
}
_PARSED = re.compile(r"^\s*([A-Za-z][A-Za-z0-9_ ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(-?\d+)\s*)?\))?\s*((?:with|without)\b.*)?$", re.I)


def driver_of(url: str) -> str:
    """The JDBC driver of a URL's dialect."""
    dialect = (re.match(r"(?:jdbc:)?([a-z0-9]+)", url.lower()) or [None, ""])[1]
    if dialect not in DRIVERS:
        raise ValueError(f"no JDBC driver known for {url!r}")
    return DRIVERS[dialect]


def parse_type(name: str) -> tuple[str, int | None, int | None]:
    """Base name in capitals, precision or length, scale."""
    m = _PARSED.match(name)
    if not m:
        return name.strip().upper(), None, None
    base = " ".join(f"{m[1]} {m[4] or ''}".upper().split())
    return base, int(m[2]) if m[2] else None, int(m[3]) if m[3] else None


def spark_type(name: str, dialect: str = "postgresql", precision: int | None = None, scale: int | None = None) -> T.DataType:
    """The Spark type of a database type such as NUMERIC(10,2); unknown names are strings."""
    base, p, s = parse_type(name)
    p, s = (p if p is not None else precision), (s if s is not None else scale)
    if base == "NUMBER" and dialect == "oracle":
        return _number(p, s)
    if base in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(min(p if p is not None else 38, 38), s or 0)
    return TYPES.get(dialect, TYPES["postgresql"]).get(base, T.StringType())


#: Digits that always fit a type of whole numbers.
_WHOLE = ((9, T.IntegerType()), (18, T.LongType()))


def _number(digits: int | None, scale: int | None) -> T.DataType:
    """The narrowest type that holds every NUMBER(digits, scale). A negative scale stands for more digits
    before the point; without digits any number may come, so half of a decimal's 38 are behind it."""
    if digits is None:
        return T.DecimalType(38, 18)
    if scale is not None and scale > 0:
        return T.DecimalType(min(38, max(digits, scale)), min(38, scale))
    whole = digits - (scale or 0)
    return next((kind for most, kind in _WHOLE if whole <= most), T.DecimalType(min(38, whole), 0))


def ddl_type(kind: T.DataType) -> str:
    """The name of a Spark type in Spark SQL."""
    return kind.simpleString().upper()


def jdbc_type(kind: T.DataType) -> str:
    """The name of a Spark type in a CREATE TABLE of a database."""
    match kind:
        case T.DecimalType():
            return f"DECIMAL({kind.precision},{kind.scale})"
        case T.StringType():
            return "VARCHAR(255)"
        case T.IntegerType():
            return "INTEGER"
        case T.ShortType() | T.ByteType():
            return "SMALLINT"
        case T.LongType():
            return "BIGINT"
        case T.DoubleType():
            return "DOUBLE PRECISION"
        case T.FloatType():
            return "FLOAT"
        case T.BooleanType():
            return "BOOLEAN"
        case T.TimestampType() | T.TimestampNTZType():
            return "TIMESTAMP"
        case T.DateType():
            return "DATE"
        case T.BinaryType():
            return "BLOB"
    return "VARCHAR(255)"


def schema_of(fields: Mapping[str, str]) -> T.StructType:
    """A schema from {column: type name}, all nullable; names as Spark SQL has them, and str, bool, float."""
    also = {"str": "string", "bool": "boolean", "long": "bigint", "integer": "int"}
    return T.StructType([T.StructField(c, T.DataType.fromDDL(also.get(t.lower(), t))) for c, t in fields.items()])


@dataclass
class Column:
    name: str
    type: str
    nullable: bool = True
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    default: str | None = None
    primary_key: bool = False


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)
    primary_keys: list[str] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    schema: str | None = None

    def struct(self, dialect: str = "postgresql") -> T.StructType:
        """The Spark schema; what it cannot say goes to the fields' metadata."""
        made = []
        for c in self.columns:
            more = {k: v for k, v in (("length", c.length), ("default", c.default)) if v is not None} | ({"primary_key": True} if c.name in self.primary_keys else {})
            made.append(T.StructField(c.name, spark_type(c.type, dialect, c.precision, c.scale), c.nullable, more))
        return T.StructType(made)


@dataclass
class Database:
    dialect: str
    tables: dict[str, Table] = field(default_factory=dict)


def infer_types(record: Mapping[str, object]) -> dict[str, str]:
    """Python type names of a record's values."""
    return {k: type(v).__name__ for k, v in record.items()}


def sql_types(types: Mapping[str, str]) -> dict[str, str]:
    """INTEGER, FLOAT, BOOLEAN or STRING for Python type names."""
    names = {"int": "INTEGER", "float": "FLOAT", "bool": "BOOLEAN"}
    return {k: names.get(v, "STRING") for k, v in types.items()}


# What the name of a column says that a table can be partitioned by.
DATED = ("created", "updated", "date")


def dated_column(struct: T.StructType) -> str | None:
    """The first date or time whose name tells that it dates the row; None without one."""
    times = {f.name: f.name.lower() for f in struct if f.dataType.typeName() in ("date", "timestamp")}
    return next(iter([name for name, low in times.items() if any(map(low.__contains__, DATED))]), None)


def create_table(table: Table, location: str | None = None, dialect: str = "postgresql", provider: str = "PARQUET", by_year_of: str | None = None) -> str:
    """Spark SQL that creates the table, partitioned by the year of by_year_of or else of dated_column, as
    a column <name>_year that writers fill."""
    struct = table.struct(dialect)
    lines = [f"  `{f.name}` {ddl_type(f.dataType)}{'' if f.nullable else ' NOT NULL'}" for f in struct]
    dated = by_year_of or dated_column(struct)
    if dated:
        lines.append(f"  `{dated}_year` INT")
    out = f"CREATE TABLE IF NOT EXISTS `{table.name}` (\n" + ",\n".join(lines) + f"\n) USING {provider}"
    out += f"\nPARTITIONED BY (`{dated}_year`)" if dated else ""
    return out + (f"\nLOCATION '{location}'" if location else "")


def create_jdbc_table(name: str, schema: T.StructType, primary_keys: Iterable[str] = ()) -> str:
    keys = list(primary_keys)
    lines = [f"{f.name} {jdbc_type(f.dataType)}{'' if f.nullable and f.name not in keys else ' NOT NULL'}" for f in schema]
    return f"CREATE TABLE {name} ({', '.join(lines + ([f'PRIMARY KEY ({", ".join(keys)})'] if keys else []))})"
