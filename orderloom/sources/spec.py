"""What to read, as data, and one reader for all kinds."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import files, sqlite


@dataclass(frozen=True)
class SourceSpec:
    """kind: csv, txt, json, sql (a SQLite file), jdbc (path: the URL) or parquet. has_header None: a header for csv, none for txt."""

    name: str
    kind: str
    path: str
    delimiter: str | None = None
    has_header: bool | None = None
    records_path: str | tuple[str, ...] | None = None
    table: str | None = None
    encoding: str = "utf-8"
    processing: str = "generic"
    columns: tuple[str, ...] = field(default_factory=tuple)


def resolve(path: str, roots: tuple[str, ...] = ()) -> str:
    """An absolute path or one with a scheme as it is; else under the first root where it exists, else in the working folder."""
    if os.path.isabs(path) or "://" in path or path.startswith("jdbc:"):
        return path
    for r in roots:
        if os.path.exists(os.path.join(r, path)):
            return os.path.join(r, path)
    return os.path.abspath(path)


def read_source(spark: SparkSession, spec: SourceSpec, roots: tuple[str, ...] = ()) -> DataFrame:
    path = resolve(spec.path, roots)
    if spec.kind == "csv":
        return files.read_csv(spark, path, spec.delimiter, spec.has_header is not False, spec.encoding)
    if spec.kind == "txt":
        return files.read_csv(spark, path, spec.delimiter or "|", bool(spec.has_header), spec.encoding)
    if spec.kind == "json":
        return files.read_json(spark, path, spec.records_path, spec.encoding)
    if spec.kind == "sql":
        return sqlite.read_table(spark, path, spec.table or "")
    if spec.kind == "jdbc":
        return spark.read.format("jdbc").option("url", spec.path).option("dbtable", spec.table).load()
    if spec.kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of source: {spec.kind}")
