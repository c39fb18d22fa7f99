"""WARC archives as a Python data source, and the records of a table of pages.

An archive is a folder of files of gzip members, one for each record. A member's header carries
the member's length in an extra field, which any gzip reader passes over; this reader first
decompresses only as far as the record's headers go, and skips the member if the pushed filters
do not want the record, or nobody wants its payload. Files are bounded by the writer; each is a
partition. A write lists its files, in a list of its own, only when all tasks have ended, so files
of lost or repeated task attempts are never read, and what was written before stays; mode
``overwrite`` removes the lists before. Paths may be any that ``pyarrow.fs`` opens, local or ``file:``,
``hdfs:``, ``s3:`` and ``gs:``.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)

from blotter.llm.tables import named

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
LEAST_REVISITED = 100
FILE_BYTES = 128 << 20
_BATCH_BYTES = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # pages have no date of their own
_HEADER = "<4sIBBHccHQ"  # magic and flags, time, 2 bytes, length of the extra field, its two letters and length, member length
_HEADER_BYTES = struct.calcsize(_HEADER)
_HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")
_LIST, _LIST_END = "_files", ".json"  # names of the lists, one for each write


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":" in path else (pyarrow.fs.LocalFileSystem(), path)


def _lists(store: pyarrow.fs.FileSystem, root: str) -> list[str]:
    found = store.get_file_info(pyarrow.fs.FileSelector(root))
    return sorted(f.path for f in found if f.base_name.startswith(_LIST) and f.base_name.endswith(_LIST_END))


def member(data: bytes) -> bytes:
    """One gzip member that tells its own length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    length = _HEADER_BYTES + len(packed) + 8
    head = struct.pack(_HEADER, b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"W", b"L", 8, length)
    return head + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _line(value: str) -> str:
    """A header value: line ends and controls as in URIs."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(row: dict) -> bytes:
    """The bytes of a record, uncompressed; a revisit has the response's HTTP headers but no payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + payload if row["record_type"] == "response" else http
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:x-record:{_line(row['record_id'])}>" if row["record_id"] is not None else None),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _line(row["target_uri"]) if row["target_uri"] is not None else None),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("WARC-Profile", _PROFILE if row["record_type"] == "revisit" else None),
        ("WARC-Refers-To", f"<urn:x-record:{_line(row['refers_to'])}>" if row["refers_to"] is not None else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _named_record(value: str | None) -> str | None:
    return value.removeprefix("<urn:x-record:").removesuffix(">") if value is not None else None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, overwrite: bool = False):
        self.path, self.file_bytes, self.overwrite = path, file_bytes, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _opened(self.path)
        files, out, size = [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    files.append([f"{uuid.uuid4().hex}.warc.gz", 0])
                    out, size = store.open_output_stream(f"{root}/{files[-1][0]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
                files[-1][1] = size
        if out is not None:
            out.close()
        written = WriterCommitMessage()
        written.files = files
        return written

    def commit(self, messages) -> None:
        store, root = _opened(self.path)
        store.create_dir(root, recursive=True)
        before = _lists(store, root) if self.overwrite else []
        with store.open_output_stream(f"{root}/{_LIST}-{uuid.uuid4().hex}{_LIST_END}") as out:
            out.write(json.dumps(sorted(f for m in messages if m is not None for f in m.files)).encode())
        for listed in before:
            store.delete_file(listed)

    def abort(self, messages) -> None:
        """Files that no list names are not read."""


class _Reader(DataSourceReader):
    def __init__(self, path: str, wants_payload: bool):
        self.path, self.wants_payload = path, wants_payload
        self.wanted: dict[str, tuple[str, ...]] = {}
        self.prefixes: dict[str, str] = {}

    def pushFilters(self, filters: list[Filter]):
        """Equality, IN and prefixes of header columns are answered from the headers."""
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in _HEADER_COLUMNS and column not in self.wanted:
                self.wanted[column] = tuple(f.value) if isinstance(f, In) else (f.value,)
            elif isinstance(f, StringStartsWith) and column in _HEADER_COLUMNS and column not in self.prefixes:
                self.prefixes[column] = f.value
            else:
                yield f

    def partitions(self):
        store, root = _opened(self.path)
        names = []
        for path in _lists(store, root):
            with store.open_input_stream(path) as listed:
                names += [name for name, size in json.loads(listed.read()) if size]
        return [InputPartition(f"{root}/{name}") for name in names] or [InputPartition("")]

    def _takes(self, row: dict) -> bool:
        return all(row[c] in values for c, values in self.wanted.items()) and all((row[c] or "").startswith(p) and row[c] is not None for c, p in self.prefixes.items())

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in _HEADER_COLUMNS] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for row in self._rows(partition.value) if partition.value else ():
            rows.append(row)
            size += len(row["payload"] or b"") + 500
            if size >= _BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def _rows(self, path: str) -> Iterator[dict]:
        store, _ = _opened(self.path)
        with store.open_input_file(path) as source:
            at, end = 0, source.size()
            while at < end:
                source.seek(at)
                length = struct.unpack(_HEADER, source.read(_HEADER_BYTES))[-1]
                unpacker = zlib.decompressobj(-15)
                left, data, rest = length - _HEADER_BYTES - 8, b"", b""
                while data.count(b"\r\n\r\n") < 2 and (left or rest):
                    if not rest:
                        rest = source.read(min(left, 4096))
                        left -= len(rest)
                    data += unpacker.decompress(rest, 4096)
                    rest = unpacker.unconsumed_tail
                head, _, block = data.partition(b"\r\n\r\n")
                fields = _fields(head)
                row = {
                    "record_id": _named_record(fields.get("warc-record-id")),
                    "record_type": fields["warc-type"],
                    "target_uri": fields.get("warc-target-uri"),
                    "refers_to": _named_record(fields.get("warc-refers-to")),
                    "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"),
                }
                if self._takes(row):
                    http, _, body = block.partition(b"\r\n\r\n")
                    row["payload_bytes"] = int(_fields(http).get("content-length", 0))
                    row["payload"] = None
                    if self.wants_payload and row["record_type"] == "response":
                        body += unpacker.decompress(rest + source.read(left)) + unpacker.flush()
                        row["payload"] = body[: int(fields["content-length"]) - len(http) - 4]
                    yield row
                at += length


class WarcSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payload=false`` leaves the payloads packed."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it push filters down."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


_SALTS = 16


def records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least: int = LEAST_REVISITED) -> DataFrame:
    """A row for each page in the archive's columns.

    Of equal payloads of at least ``least`` bytes the one with the smallest id is a response, and
    the others revisit it without payload. A null payload is empty. Pages without an id are
    responses, unless a page with an id has their payload. Rows that repeat the smallest id are
    all responses. Other columns are not read.
    """
    payload = F.coalesce(named(pages, html_column), F.lit("")).cast("binary")
    rows = pages.select(named(pages, id_column).cast("long").alias("id"), named(pages, url_column).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # A payload may be a third of all pages: its one row of the right side is repeated for each salt.
    groups = groups.filter("n > 1").select("payload_digest", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
    told = salted.join(groups, ["payload_digest", "salt"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return told.select(
        F.col("id").cast("string").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, F.col("first").cast("string")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame, path: str, **columns) -> None:
    """Write the pages' records below ``path``, beside those of earlier writes, which they do not revisit."""
    register(pages.sparkSession)
    store, root = _opened(path)
    store.create_dir(root, recursive=True)
    records(pages, **columns).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The archive's records; filters on header columns are answered before payloads are unpacked."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
