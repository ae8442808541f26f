"""Delimited text and JSON files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.semantics import split_plain, strip
from ..scratch import materialise
from .json_records import json_texts
from .records import read_records

DELIMITERS = (",", ";", "|", "\t")
SNIFF = 4096
#: Columns of the typed order records, by the names that files have.
ORDER_FIELDS = {"produto": "produto", "quantidade": "quantidade", "centro": "centro_logistico_mais_proximo", "preco": "preco_unitario", "canal": "canal_venda", "uf": "estado_cliente"}


def _head(spark: SparkSession, path: str, encoding: str) -> str:
    """The first characters of a file, or of the first file of a folder, read by Spark so that any file system will do."""
    first = spark.read.text(path).select(F.substring(F.col("value").cast("binary"), 1, SNIFF)).limit(50).collect()
    return b"\n".join(bytes(r[0]) for r in first).decode(encoding, "replace")[:SNIFF]


def sniff_delimiter(sample: str, candidates: tuple[str, ...] = DELIMITERS) -> str:
    """The most frequent candidate; of equals, and without any, the earliest."""
    return max(candidates, key=lambda d: (sample.count(d), -candidates.index(d)))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, has_header: bool = True, encoding: str = "utf-8") -> DataFrame:
    """Quoted delimited text as read_records reads it; without a delimiter, the most frequent of DELIMITERS in the first characters. A missing path raises."""
    return read_records(spark, path, delimiter or sniff_delimiter(_head(spark, path, encoding)), has_header, encoding)


def _with_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (value, file, block) in order, with head: the first line of its file that isn't blank, if it is in the first split."""
    here, found = None, True
    for batch in batches:
        files = batch.column("file")
        if found and pc.all(pc.equal(files, pa.scalar(here, files.type))).as_py():
            heads = [False] * batch.num_rows
        else:
            heads = []
            for file, block, value in zip(files.to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if file != here:
                    here, found = file, block > 0
                heads.append(not found and block == 0 and bool(value.strip()))
                found = found or heads[-1]
        yield pa.RecordBatch.from_arrays([batch.column("value"), files, pa.array(heads, pa.bool_())], ["value", "file", "head"])


def read_lines(spark: SparkSession, path: str, delimiter: str, columns: list[str] | None = None, has_header: bool = True, keep_blank: bool = False) -> DataFrame:
    """Plain split of lines, no quotes; empty fields are empty strings. Lines of another width than the header's are dropped.

    The header is the first line of the first file that isn't blank; a file's own first line goes only if it is the same.
    keep_blank: blank lines become rows of nulls instead, and widths are not checked (short rows end in nulls). Without a header
    and names, columns are col_0, col_1, ...
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.mapInArrow(_with_heads, "value string, file string, head boolean")
    first = lines.filter("head").orderBy("file").limit(1).collect()  # a line
    parts = [x.strip() for x in first[0]["value"].split(delimiter)] if first else []
    names = columns or (parts if has_header else [f"col_{i}" for i in range(len(parts))])
    if has_header and first:
        lines = lines.filter(~(F.col("head") & (F.col("value") == first[0]["value"])))
    cells = split_plain(F.col("value"), delimiter)
    rows = lines.withColumn("_c", cells)
    blank = strip(F.col("value")) == ""
    rows = rows if keep_blank else rows.filter(~blank & (F.size("_c") == len(names)))
    get = lambda i: F.when(~blank, strip(F.get("_c", F.lit(i))))
    return rows.select(*[get(i).alias(n) for i, n in enumerate(names)])


def read_json(spark: SparkSession, path: str, records_path: str | list[str] | tuple[str, ...] | None = None, encoding: str = "utf-8") -> DataFrame:
    """Whole-document JSON, read in splits: the list at the root, or under a key or a list of keys. Items that aren't objects are dropped.

    A path that leads nowhere, a document that is cut short or a list of which an object doesn't parse gives an empty frame.
    """
    keys = [records_path] if isinstance(records_path, str) else list(records_path or [])
    text = materialise(json_texts(spark, path, keys, encoding), "records")
    # the schema is that of all objects
    found = text.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("try_parse_json(j) IS NULL")).alias("bad"), F.expr("schema_of_variant_agg(try_parse_json(j))").alias("s")).first()
    if not found["n"] or found["bad"]:
        return spark.createDataFrame([], "_empty string").select()
    ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", found["s"].replace("OBJECT<", "STRUCT<")).replace("VOID", "STRING")
    return text.select(F.from_json("j", ddl).alias("r")).select("r.*")


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed order records of a CSV file; rows with a missing field or one that doesn't convert are dropped."""
    return typed_orders(read_csv(spark, path))


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Typed order records of the list `pedidos` of a JSON file."""
    df = read_json(spark, path, "pedidos")
    return typed_orders(df) if df.columns else typed_orders(spark.createDataFrame([], ", ".join(f"{c} string" for c in ORDER_FIELDS.values())))


def typed_orders(df: DataFrame) -> DataFrame:
    kinds = {"quantidade": "int", "preco": "double"}
    have = set(df.columns)
    out = df.select(*[(F.col(c) if c in have else F.lit(None)).cast("string").try_cast(kinds.get(n, "string")).alias(n) for n, c in ORDER_FIELDS.items()])
    return out.filter(" AND ".join(f"{n} IS NOT NULL" for n in ORDER_FIELDS))


def newest_batch(df: DataFrame, time: str, n: int) -> DataFrame:
    """The first n rows by time that are not processed yet."""
    return df.filter(~F.col("processed_by_etl")).orderBy(time, "event_pk").limit(n)
