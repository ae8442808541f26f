"""Order and event messages: schemas, landing folders, claimed batches, and a stream of files by name."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..scratch import materialise
from .claims import last_offset, open_folder

ORDER_MESSAGE = (
    "id int, cliente_id int, produto_id int, categoria_id int, produto string, quantidade int, preco_unitario float, valor_total float, data_pedido string, hora_pedido string, "
    "mes int, ano int, canal_venda string, centro_logistico_mais_proximo string, cidade_cliente string, estado_cliente string, dias_para_entrega int, registrado_em string"
)
ORDER_LIST = f"id int, id_client int, pedidos array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ORDER_MESSAGE.split(', '))}>>"
EVENT_MESSAGE = "id int, payload string, values array<int>, timestamp_emission long"


def message_stream(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    """Messages as JSON lines that land in a folder; at most max_files files a batch hold the source back."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(folder)


def single_orders(df: DataFrame) -> DataFrame:
    """Landed orders: the message's fields, and when they were taken in."""
    return df.drop("id").withColumn("registrado_em", F.localtimestamp())


def listed_orders(df: DataFrame) -> DataFrame:
    """The orders of list messages, one a row."""
    return single_orders(df.select(F.explode("pedidos").alias("p")).select("p.*"))


def received_events(df: DataFrame) -> DataFrame:
    """Event messages as staged rows: the client is id div 1000."""
    return df.select(
        F.col("id").alias("client_event_id"), F.call_function("div", F.col("id"), F.lit(1000)).cast("int").alias("client_id"), "payload", F.col("values").alias("values_array"),
        "timestamp_emission", F.localtimestamp().alias("timestamp_received"), F.lit(False).alias("processed_by_etl"),
    )


def claim_batch(events: DataFrame, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """(the first n unprocessed events by time received, all events with these marked as processed)."""
    batch = events.filter(~F.col("processed_by_etl")).orderBy("timestamp_received", "event_pk").limit(n)
    mark = batch.select("event_pk", F.lit(True).alias("_taken"))
    rest = events.join(mark, "event_pk", "left").withColumn("processed_by_etl", F.col("processed_by_etl") | F.coalesce("_taken", F.lit(False))).drop("_taken")
    return batch, rest


def claim_from(table, n: int = 100) -> DataFrame:
    """claim_batch of a VersionedTable of events: the claim is written, and of two that claim at once one reads anew, so no event is claimed twice."""
    taken: list[DataFrame] = []

    def change(events: DataFrame | None) -> DataFrame | None:
        taken.clear()
        if events is None:
            return None
        batch, rest = claim_batch(events, n)
        taken.append(materialise(batch, "claimed"))
        return None if taken[0].isEmpty() else rest

    table.update(change)
    if not taken:
        raise ValueError("no events table")
    return taken[0]


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class NamedFilesReader(DataSourceStreamReader):
    """Files of a folder in order of name; the offset is the last name, so files of lesser names that come later are never read.

    A batch takes max_files files at most (0: all), counted from the offset the stream has got to.
    """

    def __init__(self, folder: str, suffix: str, max_files: int = 0, start: str = ""):
        self.folder, self.suffix, self.max_files, self.at = folder, suffix, max_files, start

    def _files(self) -> dict[str, str]:
        """Paths by name, in order of name."""
        fs, base = open_folder(self.folder)
        found = {f.base_name: f.path for f in fs.get_file_info(FileSelector(base)) if f.is_file}
        return {n: found[n] for n in sorted(found) if n.endswith(self.suffix) and not n.startswith((".", "_"))}

    def initialOffset(self) -> dict:
        return {"name": ""}

    def latestOffset(self) -> dict:
        new = [n for n in self._files() if n > self.at]
        if new:
            self.at = new[min(self.max_files or len(new), len(new)) - 1]
        return {"name": self.at}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(path) for n, path in self._files().items() if start["name"] < n <= end["name"]]

    def read(self, partition: File) -> Iterator[tuple[str, str]]:
        fs, _ = open_folder(self.folder)
        with io.TextIOWrapper(fs.open_input_stream(partition.path), encoding="utf-8", errors="replace") as f:
            for line in f:
                yield os.path.basename(partition.path), line.rstrip("\r\n")

    def commit(self, end: dict) -> None:
        """The offset lives in the query's checkpoint; nothing is kept here."""


class NamedFiles(DataSource):
    """Format "named_files". Options: path (a folder that the cluster shares), suffix, maxfiles, start. Columns: file, value."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, value string"

    def streamReader(self, schema) -> NamedFilesReader:
        return NamedFilesReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("maxfiles", "0")), self.options.get("start", ""))


def files_by_name(spark: SparkSession, folder: str, suffix: str = "", max_files: int = 0, checkpoint: str | None = None) -> DataFrame:
    """A stream of the lines of files by name. max_files holds it back: so many files a batch, k files in k / max_files batches rounded up; hand in
    the checkpoint of the query then, as a stream that is taken up counts its files from there."""
    spark.dataSource.register(NamedFiles)
    reader = spark.readStream.format("named_files").option("path", folder).option("suffix", suffix).option("maxfiles", max_files)
    at = last_offset(spark, checkpoint) if checkpoint else None
    return (reader.option("start", at["name"]) if at else reader).load()


def files_after(spark: SparkSession, names: list[str], marker: str | None) -> tuple[list[str], str | None]:
    """(names beyond the marker in order, the new marker)."""
    new = sorted(n for n in names if marker is None or n > marker)
    return new, (new[-1] if new else marker)
