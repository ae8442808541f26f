"""WARC archives as a PySpark Python data source, and deduplicated writing with revisit records.

Reading plans partitions by files, takes predicates on the record type and other headers, parses headers first and leaves the
payloads of records that are not wanted undecoded. Each record is a gzip member of its own, with its length in the member's
header (extra field "sl"), so that a reader can step over it; plain WARC and gzip members without that field are read too.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from .common import BROADCAST_ROWS, materialise, scratch_path, table

READ_SCHEMA = "page_id long, record_id string, record_type string, target_uri string, payload_digest string, refers_to long, content_length long, payload_bytes long, payload binary"
WRITE_SCHEMA = "page_id long, url string, payload string, sha1 string, payload_bytes long, record_type string, refers_to long"
#: A new file begins beyond so many bytes; readers get about PARTITION_BYTES each.
FILE_BYTES = 128 << 20
PARTITION_BYTES = 64 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_CHUNK = 1 << 16
_HEADER = 1 << 12


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it: with a scheme or a local one."""
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field "sl" holds its own length and that of the data, both 32-bit (0 where beyond)."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size if size < 1 << 32 else 0, len(data) if len(data) < 1 << 32 else 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def page_urn(page_id: int) -> str:
    return f"<urn:x-page:{page_id}>"


def _page_of(urn: str | None) -> int | None:
    return int(urn[12:-1]) if urn and urn.startswith("<urn:x-page:") else None


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceWriter):
    """Each task writes files of its own under names not used before; only those of committed tasks are in the manifest."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for r in rows:
            if out is None or size > FILE_BYTES:
                if out:
                    out.close()
                names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                out, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None, buffer_size=1 << 20), 0
            data = member(record(*self._record(r)))
            out.write(data)
            size += len(data)
        if out:
            out.close()
        return Written(names)

    def _record(self, r) -> tuple[list[tuple[str, str]], bytes]:
        digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
        own = [("WARC-Record-ID", page_urn(r["page_id"]))] if r["page_id"] is not None else [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")]
        headers = [("WARC-Type", r["record_type"]), *own, ("WARC-Date", "1970-01-01T00:00:00Z")]
        if r["url"] is not None:
            headers.append(("WARC-Target-URI", r["url"].replace("\r", "%0D").replace("\n", "%0A")))
        headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(r["payload_bytes"]))]
        if r["record_type"] == "revisit":
            headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", page_urn(r["refers_to"]))]
            return headers, HTTP % r["payload_bytes"]
        payload = (r["payload"] or "").encode()
        return headers, HTTP % len(payload) + payload

    def commit(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names = sorted(n for m in messages if m for n in m.files)
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}", compression=None) as f:
            f.write("\n".join(names).encode())

    def abort(self, messages: list) -> None:
        fs, root = _filesystem(self.path)
        for n in (n for m in messages if m for n in m.files):
            fs.delete_file(f"{root}/{n}")


@dataclass
class Files(InputPartition):
    names: list[str]


class _Source:
    """A file with some bytes put back."""

    def __init__(self, f):
        self.f, self.back = f, b""

    def read(self, n: int) -> bytes:
        if self.back:
            data, self.back = self.back[:n], self.back[n:]
            return data if len(data) == n else data + self.read(n - len(data))
        return self.f.read(n)

    def skip(self, n: int) -> None:
        have = min(n, len(self.back))
        self.back = self.back[have:]
        if n > have:
            self.f.seek(n - have, 1)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def records(f, wanted, needed=lambda fields: True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the records whose headers are wanted, block None where it is not needed; blocks of others, and those not needed, are stepped over, or inflated piece by piece and dropped."""
    src = _Source(f)
    while len(magic := src.read(12)) == 12:
        if magic[:5] == b"WARC/":
            head = magic
            while b"\r\n\r\n" not in head:
                more = src.read(_HEADER)
                if not more:
                    raise ValueError("a WARC header does not end")
                head += more
            head, _, rest = head.partition(b"\r\n\r\n")
            src.back = rest + src.back
            fields = _fields(head)
            n = int(fields["content-length"])
            use = wanted(fields)
            if use and needed(fields):
                yield fields, src.read(n)
            else:
                src.skip(n)
                if use:
                    yield fields, None
            src.skip(4)
            continue
        if magic[:3] != b"\x1f\x8b\x08":
            raise ValueError("neither a WARC record nor a gzip member")
        extra = src.read(struct.unpack("<H", magic[10:])[0]) if magic[3] & 4 else b""
        size = struct.unpack("<I", extra[4:8])[0] if extra[:4] == b"sl\x08\0" and magic[3] == 4 else 0
        if size:
            left = size - 12 - len(extra)
            body = src.read(min(left, _HEADER))
            d = zlib.decompressobj(-15)
            text = d.decompress(body, _HEADER)
            while b"\r\n\r\n" not in text:
                if not d.unconsumed_tail and len(body) < left:
                    more = src.read(min(left - len(body), _HEADER))
                    body += more
                    text += d.decompress(more, _HEADER)
                elif d.unconsumed_tail:
                    text += d.decompress(d.unconsumed_tail, _HEADER)
                else:
                    raise ValueError("a WARC header does not end")
            head, _, start = text.partition(b"\r\n\r\n")
            fields = _fields(head)
            use = wanted(fields)
            if use and needed(fields):
                rest = d.unconsumed_tail + src.read(left - len(body))
                yield fields, (start + d.decompress(rest) + d.flush())[: int(fields["content-length"])]
            else:
                src.skip(left - len(body))
                if use:
                    yield fields, None
            continue
        # a member of unknown length: inflate it, and keep its bytes only while they may be wanted
        src.back = magic + extra + src.back
        d, text, fields, use, keep = zlib.decompressobj(31), bytearray(), None, False, True
        while not d.eof:
            data = src.read(_CHUNK)
            if not data:
                raise ValueError("a gzip member does not end")
            piece = d.decompress(data)
            if keep:
                text += piece
            if fields is None and (end := text.find(b"\r\n\r\n", max(0, len(text) - len(piece) - 3))) >= 0:
                fields = _fields(bytes(text[:end]))
                use = wanted(fields)
                keep = use and needed(fields)
                text = text[end + 4 :] if keep else bytearray()
        src.back = d.unused_data + src.back
        if use:
            yield fields, bytes(text[: int(fields["content-length"])]) if keep else None


#: Columns that headers give, and how.
_COLUMNS = {
    "record_id": lambda h: h.get("warc-record-id"),
    "record_type": lambda h: h.get("warc-type"),
    "target_uri": lambda h: h.get("warc-target-uri"),
    "payload_digest": lambda h: (h.get("warc-payload-digest") or "").rpartition(":")[2] or None,
    "page_id": lambda h: _page_of(h.get("warc-record-id")),
    "refers_to": lambda h: _page_of(h.get("warc-refers-to")),
    "content_length": lambda h: int(h["content-length"]),
}
_TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    IsNotNull: lambda x, v: x is not None,
}
#: Comparisons by their names in the option `where`.
_NAMES = {"=": EqualTo, "in": In, ">": GreaterThan, ">=": GreaterThanOrEqual, "<": LessThan, "<=": LessThanOrEqual, "prefix": StringStartsWith, "not null": IsNotNull}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool, where: list):
        self.path, self.payload, self.verify = path, payload, verify
        self.tests: list[tuple[str, type, object]] = [(c, _NAMES[op], v) for c, op, v in where]

    def partitions(self) -> list[Files]:
        fs, root = _filesystem(self.path)
        info = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if fs.get_file_info(root).type != pafs.FileType.File else [fs.get_file_info(root)]
        sizes = {x.path: x.size for x in info if x.type == pafs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))}
        marks = [x.path for x in info if x.base_name.startswith("_manifest-")]
        if marks:  # files of tasks that were not committed don't count
            named: set[str] = set()
            for m in marks:
                with fs.open_input_stream(m, compression=None) as f:
                    named |= set(f.read().decode().split("\n"))
            sizes = {k: v for k, v in sizes.items() if k.rpartition("/")[2] in named}
        out: list[tuple[int, list[str]]] = []
        for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):  # first fit in falling order
            k = next((i for i, (s, _) in enumerate(out[-8:], max(0, len(out) - 8)) if s + size <= PARTITION_BYTES), None)
            if k is None:
                out.append((size, [name]))
            else:
                out[k] = (out[k][0] + size, [*out[k][1], name])
        return [Files(names) for _, names in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        tests = [(_COLUMNS[c], _TESTS[k], v) for c, k, v in self.tests]
        fs, _ = _filesystem(self.path)
        rows, size = [], 0
        for name in partition.names:
            with fs.open_input_file(name) as f:
                # without payloads and their check, a header that has the length will do
                for h, block in records(f, lambda h: all(t(get(h), v) for get, t, v in tests), lambda h: self.payload or self.verify or "x-payload-length" not in h):
                    payload = (block or b"").partition(b"\r\n\r\n")[2]
                    kind = h.get("warc-type")
                    n = int(h["x-payload-length"]) if block is None or (kind == "revisit" and "x-payload-length" in h) else len(payload)
                    digest = _COLUMNS["payload_digest"](h)
                    if self.verify and kind == "response" and digest and digest != base32_sha1(payload):
                        raise ValueError(f"{name}: the payload of {h.get('warc-record-id')} does not match its digest")
                    rows.append((*(_COLUMNS[c](h) for c in ("page_id", "record_id", "record_type", "target_uri")), digest, _COLUMNS["refers_to"](h), int(h["content-length"]), n, payload if self.payload and kind != "revisit" else None))
                    size += len(payload) if self.payload else 0
                    if len(rows) >= 4096 or size > 16 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


class PushingWarcReader(WarcReader):
    """Takes the plan's filters on header columns as well."""

    def pushFilters(self, filters: list):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _COLUMNS:
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f


_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in READ_SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class WarcDataSource(DataSource):
    """Format "warc".

    Options: path; payload ("false": payloads stay out of the rows); verify ("true": response payloads are held against their
    digests); where (JSON list of [column, comparison, value], met by headers before a block is decoded); pushdown ("true": the
    plan's filters too).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        kind = PushingWarcReader if self.options.get("pushdown", "false").lower() == "true" else WarcReader
        return kind(self.options["path"], self.options.get("payload", "true").lower() == "true", self.options.get("verify", "false").lower() == "true", json.loads(self.options.get("where", "[]")))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record for each page. Of pages with equal payloads of at least min_bytes bytes the one of the largest page_id is the response, the others revisit it.

    Null html: an empty payload. Null page_id: a record id of its own; it is less than any other. Rows that repeat the largest
    page_id with the same payload are the same page, so all are responses. If all of a group have a null page_id, all are
    responses. An empty table writes an archive without records. Other columns are not written.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit(""))
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    groups = own.filter(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("k"))
    groups = materialise(groups.filter("k > 1 AND top IS NOT NULL").select("sha1", "top"), "payloads")
    # only payloads that repeat; broadcast if counted to be few, else a plain join that Spark splits at a hot payload
    out = own.join(F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups, "sha1", "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    out = out.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("top")), "payload": F.when(~again, F.col("payload"))})
    out.select("page_id", "url", "payload", "sha1", "payload_bytes", "record_type", "refers_to").write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True, verify: bool = False, where: list[tuple[str, str, object]] | None = None, pushdown: bool = False) -> DataFrame:
    """The records of an archive whose headers meet `where`.

    pushdown: filters of the plan on header columns are pushed down as well. Spark 4.1 then keeps the filters of a DataFrame's
    first query for its later ones, so read the archive anew for each query.
    """
    register(spark)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc").option("payload", str(payload).lower()).option("verify", str(verify).lower()).option("pushdown", str(pushdown).lower())
    return reader.option("where", json.dumps(where or [])).load(path)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, which are held against their digests; revisits by their headers alone."""
    path = scratch_path(spark, "warc")
    write_pages(table(spark, sf_dir, "pages"), path)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = read_archive(spark, path, payload=False, verify=True, where=[("record_type", "=", "response")]).select(*columns)
    revisits = read_archive(spark, path, payload=False, where=[("record_type", "=", "revisit"), ("refers_to", "not null", None)]).select(*columns)
    return responses.unionByName(revisits)


OP4_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(10 * (k // 8) + 1 AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""
