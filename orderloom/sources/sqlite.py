"""SQLite tables as a Python data source, for reading with pushed filters and for writing."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of one partition, by rowid.
ROWS = 500_000
_OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kind(declared: str) -> str:
    d = declared.upper()
    if "INT" in d:
        return "bigint"
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return "double"
    if "BOOL" in d:
        return "boolean"
    return "string"


@dataclass
class Rows(InputPartition):
    low: int
    high: int | None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, where: list):
        self.path, self.table, self.schema = path, table, schema
        self.where: list[str] = []
        self.values: list = []
        for column, op, value in where:
            if op not in ("=", "<>", "<", "<=", ">", ">=", "in"):
                raise ValueError(f"unknown comparison: {op}")
            self.where.append(f"{quoted(column)} {'IN (' + ', '.join('?' * len(value)) + ')' if op == 'in' else op + ' ?'}")
            self.values += list(value) if op == "in" else [value]

    def partitions(self) -> list[Rows]:
        with sqlite3.connect(self.path) as con:
            try:
                view = con.execute("SELECT 1 FROM sqlite_master WHERE type = 'view' AND name = ?", [self.table]).fetchone()
                if view:
                    return [Rows(0, None)]
                low, high = con.execute(f"SELECT COALESCE(MIN(rowid), 0), COALESCE(MAX(rowid), -1) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                low = high = None  # a table without row ids
        if low is None:
            return [Rows(0, None)]  # read by one task, as a view is
        return [Rows(a, min(a + ROWS - 1, high)) for a in range(low, high + 1, ROWS)] or [Rows(0, -1)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(quoted(f.name) for f in self.schema)
        whole = partition.high is None
        cond = " AND ".join([*([] if whole else ["rowid BETWEEN ? AND ?"]), *self.where]) or "TRUE"
        make = [{"bigint": lambda v: v if isinstance(v, int) else None, "double": lambda v: float(v) if isinstance(v, (int, float)) else None, "boolean": lambda v: None if v is None else bool(v)}.get(f.dataType.simpleString(), lambda v: None if v is None else str(v)) for f in self.schema]
        con = sqlite3.connect(self.path)
        try:
            for row in con.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {cond}", [*([] if whole else [partition.low, partition.high]), *self.values]):
                yield tuple(m(v) for m, v in zip(make, row, strict=True))
        finally:
            con.close()


class PushingSqliteReader(SqliteReader):
    """Takes the plan's filters as well."""

    def pushFilters(self, filters: list):
        for f in filters:
            column = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            plain = lambda v: isinstance(v, (int, float, str))
            if column and type(f) in _OPS and plain(value):
                self.where.append(f"{column} {_OPS[type(f)]} ?")
                self.values.append(value)
            elif column and type(f) is In and all(map(plain, value)):
                self.where.append(f"{column} IN ({', '.join('?' * len(value))})")
                self.values += list(value)
            elif column and type(f) in (IsNull, IsNotNull):
                self.where.append(f"{column} IS {'NOT ' * (type(f) is IsNotNull)}NULL")
            else:
                yield f


@dataclass
class Part(WriterCommitMessage):
    rows: int


class SqliteWriter(DataSourceWriter):
    """Each task inserts in one transaction; SQLite takes one writer at a time, so writers wait. Tables are made before the tasks start."""

    def __init__(self, path: str, table: str, columns: list[str], keys: list[str], updates: dict[str, str]):
        self.path, self.table, self.columns, self.keys, self.updates = path, table, columns, keys, updates

    def write(self, rows: Iterator) -> Part:
        con = sqlite3.connect(self.path, timeout=300)
        n = 0
        try:
            with con:
                sql = f"INSERT INTO {quoted(self.table)} ({', '.join(map(quoted, self.columns))}) VALUES ({', '.join('?' * len(self.columns))})"
                if self.keys:
                    sets = ", ".join(f"{quoted(c)} = {e}" for c, e in self.updates.items())
                    sql += f" ON CONFLICT ({', '.join(map(quoted, self.keys))}) DO " + (f"UPDATE SET {sets}" if sets else "NOTHING")
                con.executemany(sql, (tuple(r) for r in rows))
                n = con.total_changes
        finally:
            con.close()
        return Part(n)


class SqliteDataSource(DataSource):
    """Format "sqlite". Options: path, table, where (JSON list of [column, comparison, value]). The columns are those of the table."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        columns = table_columns(self.options["path"], self.options["table"])
        return ", ".join(f"`{n}` {_kind(t)}" for n, t in columns)

    def reader(self, schema: StructType) -> SqliteReader:
        kind = PushingSqliteReader if self.options.get("pushdown", "false").lower() == "true" else SqliteReader
        return kind(self.options["path"], self.options["table"], schema, json.loads(self.options.get("where", "[]")))

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(self.options["path"], self.options["table"], schema.names, json.loads(self.options.get("keys", "[]")), json.loads(self.options.get("updates", "{}")))


def table_columns(path: str, table: str) -> list[tuple[str, str]]:
    with sqlite3.connect(path) as con:
        found = [(r[1], r[2]) for r in con.execute(f"PRAGMA table_info({quoted(table)})")]
    if not found:
        raise ValueError(f"no table {table!r} in {path}")
    return found


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteDataSource)


def read_table(spark: SparkSession, path: str, table: str, where: list[tuple[str, str, object]] | None = None, pushdown: bool = False) -> DataFrame:
    """The rows of a table that meet `where`, which SQLite evaluates. A missing table raises ValueError.

    pushdown: filters of the plan run inside SQLite as well. Spark 4.1 then keeps the filters of a DataFrame's first query for
    its later ones, so read the table anew for each query.
    """
    table_columns(path, table)
    register(spark)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").option("path", path).option("table", table).option("where", json.dumps(where or [])).option("pushdown", str(pushdown).lower()).load()


def load_tables(spark: SparkSession, path: str, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    """Several tables, cached for repeated use."""
    return {t: read_table(spark, path, t).cache() for t in tables}


def write_table(df: DataFrame, path: str, table: str, if_exists: str = "append", as_text: bool = True) -> None:
    """Append to, replace, or fail on an existing table. as_text: all columns are text; nulls stay. A frame without rows changes nothing.

    Rows go in by one partition: SQLite has a single writer, and a failed task must not leave half of its rows beside a retry's.
    """
    if if_exists not in ("append", "replace", "fail"):
        raise ValueError(if_exists)
    if df.isEmpty():
        return
    register(df.sparkSession)
    if as_text:
        df = df.select(*[(F.initcap(F.col(f"`{c}`").cast("string")) if t == "boolean" else F.col(f"`{c}`").cast("string")).alias(c) for c, t in df.dtypes])
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN"}
    with sqlite3.connect(path) as con:
        there = con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", [table]).fetchone()
        if there and if_exists == "fail":
            raise ValueError(f"table {table!r} exists")
        if there and if_exists == "replace":
            con.execute(f"DROP TABLE {quoted(table)}")
        con.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({', '.join(f'{quoted(c)} {kinds.get(t, "TEXT")}' for c, t in df.dtypes)})")
    df.coalesce(1).write.format("sqlite").option("path", path).option("table", table).mode("append").save()


def upsert_table(df: DataFrame, path: str, table: str, keys: list[str], updates: dict[str, str] | None = None) -> None:
    """Insert rows; a row of keys that are there updates it by `updates`: column to SQL expression, where `excluded` is the new row (default: all other columns take its values).

    Without the table, one is made whose primary key are `keys`; else these need a unique index. One partition, one
    transaction: a retry after a failure begins anew.
    """
    updates = {c: f"excluded.{quoted(c)}" for c in df.columns if c not in keys} if updates is None else updates
    register(df.sparkSession)
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN"}
    with sqlite3.connect(path) as con:
        con.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({', '.join(f'{quoted(c)} {kinds.get(t, "TEXT")}' for c, t in df.dtypes)}, PRIMARY KEY ({', '.join(map(quoted, keys))}))")
    df.coalesce(1).write.format("sqlite").option("path", path).option("table", table).option("keys", json.dumps(keys)).option("updates", json.dumps(updates)).mode("append").save()
