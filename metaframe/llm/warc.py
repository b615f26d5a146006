"""WARC archives as a PySpark data source, "warc", for reading and writing.

Reading plans partitions of whole files, bundled by size. Filters on record_type, record_id, target_uri and
refers_to are pushed down: each record's headers are parsed first, and where they fail a filter the payload
is not decoded. Archives of this writer name each record's compressed length in a gzip extra field, so such
records are skipped with a seek; other gzip archives must be inflated to find the next record, but nothing is
kept of it. The option payload says how much of the payload is wanted: "full" (default), "digest" (length
and digest of the decoded payload, without the payload) or "none" (headers only).

Writing makes one file a task under a name of its own; the commit lists the files of the tasks that succeeded
in a manifest, and readers read what the manifest lists. So repeated and lost tasks leave no record twice.

Spark keeps pushed filters with the loaded frame, so load an archive anew for each query with other filters.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from metaframe.llm.shared import fresh_path, small, written

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_length long, payload_digest string, payload binary"
MANIFEST = "_manifest.json"
#: Bytes of archives in a partition, unless a single file has more.
PARTITION_BYTES = 64 << 20
#: Smallest payload for which a repeated one is written as a revisit.
REVISIT_FROM = 0
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to"}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header's value: control characters, which would end it, percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field "sl" holds its compressed length (0: 4 GiB or more) and uncompressed length."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    total = 10 + 2 + 12 + len(packed) + 8
    extra = b"sl" + (8).to_bytes(2, "little") + (total if total < 1 << 32 else 0).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + len(extra).to_bytes(2, "little") + extra + packed + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def record(record_id: str, record_type: str, target_uri: str | None, date: str | None, refers_to: str | None, payload: bytes | None, length: int | None = None, digest: str | None = None) -> bytes:
    """One record. A revisit has no payload, but names the length and digest of the one that it repeats."""
    if record_type == "revisit":
        block = _HTTP % (length or 0)
    else:
        payload = payload or b""
        length, digest = len(payload), sha1_base32(payload)
        block = _HTTP % length + payload
    head = [("WARC-Type", record_type), ("WARC-Record-ID", record_id), ("WARC-Date", date or "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target_uri)]
    head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)] if record_type == "revisit" else []
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(length)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {_line(v)}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = pafs.FileSystem.from_uri(self.path)
        name, out, size = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in iterator:
            columns = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            column = lambda c: columns[c] if c in columns else pa.nulls(batch.num_rows)  # noqa: E731, B023
            for row in zip(*(column(c) for c in ("record_id", "record_type", "target_uri", "date", "refers_to", "payload", "payload_length", "payload_digest")), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)  # the name would ask for another gzip
                data = gzip_member(record(*(x.as_py() for x in row)))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(name if out is not None else "", size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files = {m.name: m.size for m in messages if m and m.name}
        if not self.overwrite and fs.get_file_info(f"{root}/{MANIFEST}").is_file:
            files = json.loads(fs.open_input_stream(f"{root}/{MANIFEST}").read()) | files
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int


@dataclass
class Files(InputPartition):
    names: list[str]

    def __post_init__(self) -> None:
        super().__init__(self.names)


class _Ahead:
    """Bytes that were read but not taken, as a list of parts: what is added or taken costs its own length only."""

    def __init__(self) -> None:
        self.parts: deque[bytes] = deque()
        self.size = self.begin = 0  # bytes that are left, and where they begin in the first part

    def _more(self, n: int) -> bytes:
        """The next bytes of the source, about n; none at its end."""
        raise NotImplementedError

    def add(self, data: bytes) -> None:
        if data:
            self.parts.append(data)
            self.size += len(data)

    def put_back(self, data: bytes) -> None:
        if data:
            if self.begin:
                self.parts[0], self.begin = self.parts[0][self.begin :], 0
            self.parts.appendleft(data)
            self.size += len(data)

    def peek(self, n: int) -> bytes:
        """The next n bytes, or as many as there are, which stay ahead."""
        while self.size < n and (got := self._more(n - self.size)):
            self.add(got)
        if self.parts and len(self.parts[0]) - self.begin >= n:
            return self.parts[0][self.begin : self.begin + n]
        self.put_back(out := self._cut(n))
        return out

    def _cut(self, n: int) -> bytes:
        out, left = [], min(n, self.size)
        self.size -= left
        while left:
            part = self.parts[0]
            got = part[self.begin : self.begin + left] if self.begin or left < len(part) else part
            out.append(got)
            left -= len(got)
            self.begin += len(got)
            if self.begin == len(part):
                self.parts.popleft()
                self.begin = 0
        return out[0] if len(out) == 1 else b"".join(out)

    def take(self, n: int) -> bytes:
        while self.size < n and (got := self._more(n - self.size)):
            self.add(got)
        return self._cut(n)

    def drop(self) -> None:
        self.parts.clear()
        self.size = self.begin = 0

    def skip(self, n: int) -> None:
        while n > 0 and (got := len(self.take(min(n, 1 << 18)))):
            n -= got


class _Stream(_Ahead):
    """A file read forward in blocks, with what is ahead looked at before it is taken."""

    def __init__(self, file: pa.NativeFile, block: int = 1 << 18):
        super().__init__()
        self.file, self.block = file, block

    def _more(self, n: int) -> bytes:
        return self.file.read(max(self.block, n))

    def skip(self, n: int) -> None:
        if n <= self.size:
            self._cut(n)
        else:
            self.file.seek(self.file.tell() + n - self.size)
            self.drop()


class _Inflated(_Ahead):
    """The content of one gzip member, with the same methods."""

    def __init__(self, source: _Stream, length: int = 0):
        super().__init__()
        self.source, self.z, self.left = source, zlib.decompressobj(31), length or 1 << 62  # bytes of the member that are not taken

    def _more(self, n: int) -> bytes:
        out = b""
        while not out and not self.z.eof:
            if not (packed := self.z.unconsumed_tail):
                self.source.peek(1)
                packed = self.source.take(min(self.left, self.source.size, 1 << 16))
                self.left -= len(packed)
            if not packed:
                break
            out = self.z.decompress(packed, max(1 << 16, min(n, 1 << 20)))
        return out

    def finish(self) -> None:
        self.drop()
        while self._more(1 << 18):
            pass
        self.source.put_back(self.z.unused_data)


def _head(source: _Stream | _Inflated) -> dict[str, str] | None:
    """The headers of the record that comes next, names in lower case; None at the end."""
    n = 1 << 10
    while (at := (ahead := source.peek(n)).find(b"\r\n\r\n")) < 0:
        if len(ahead) < n:
            return None
        n *= 2
    lines = source.take(at + 4).decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _body(head: dict[str, str], source: _Stream | _Inflated, mode: str) -> tuple[int | None, str | None, bytes | None]:
    """Length, digest and payload. A revisit's are those that its headers name."""
    length = int(head.get("content-length", 0))
    if head.get("warc-type") == "revisit" or mode == "none":
        source.skip(length)
        named = head.get("x-payload-length")
        return int(named) if named else None, (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, None
    block = source.take(length)
    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
    return len(payload), sha1_base32(payload), payload if mode == "full" else None


def _records(file: pa.NativeFile, wanted: list[tuple[str, str, tuple]], mode: str) -> Iterator[tuple]:
    source = _Stream(file)
    passes = lambda h: all(any((h.get(k) or "").startswith(v) for v in vs) if how == "starts" else h.get(k) in vs for k, how, vs in wanted)
    while start := source.peek(24):
        if start[:2] == b"\x1f\x8b":
            total = int.from_bytes(start[16:20], "little") if start[3] & 4 and start[12:14] == b"sl" else 0
            inside = _Inflated(source, total)
            head = _head(inside)
            if head is not None and passes(head):
                yield (*(head.get(h) for h in ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-refers-to")), *_body(head, inside, mode))
            if total:
                source.skip(inside.left)
            else:
                inside.finish()
        else:
            if start[:2] == b"\r\n":
                source.take(2)
                continue
            head = _head(source)
            if head is None:
                return
            if passes(head):
                yield (*(head.get(h) for h in ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-refers-to")), *_body(head, source, mode))
            else:
                source.skip(int(head.get("content-length", 0)))


class Reader(DataSourceReader):
    def __init__(self, path: str, mode: str):
        self.path, self.mode, self.wanted = path, mode, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = _HEADERS.get(f.attribute[0]) if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 else None
            if name is None:
                yield f
            elif isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", (f.value,)))
            else:
                self.wanted.append((name, "is", tuple(f.value) if isinstance(f, In) else (f.value,)))

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").is_file:
            files = {f"{root}/{k}": v for k, v in json.loads(fs.open_input_stream(f"{root}/{MANIFEST}").read()).items()}
        elif fs.get_file_info(root).is_file:
            files = {root: 0}
        else:
            files = {i.path: i.size for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file and re.search(r"\.warc(\.gz)?$", i.path)}
        out, size = [], 0
        for name, n in sorted(files.items()):
            if not out or size + n > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append(name)
            size += n
        return [Files(x) for x in out]

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in SCHEMA.split(", ")]
        batch = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for name in partition.names:
            with fs.open_input_file(name) as file:
                rows, size = [], 0
                for row in _records(file, self.wanted, self.mode):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "full"))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record for each page, its payload the html in UTF-8 (null: empty).

    Of pages with equal payloads of at least REVISIT_FROM bytes, that of the largest id is a response and
    others are revisits of it; rows that repeat that id are responses too, and so are pages whose payload
    occurs with null ids only. Null urls have no header. Other columns are not looked at.
    """
    register(pages.sparkSession)
    pages = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    copies = pages.where(F.length("payload") >= REVISIT_FROM).groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    copies = small(written(copies, "copies"))
    marked = pages.join(copies, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    name = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">")), F.lit("<urn:page>"))
    marked.select(
        name("id").alias("record_id"), F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(F.col("revisit"), name("first")).alias("refers_to"), F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
        F.length("payload").cast("long").alias("payload_length"), F.when(F.col("revisit"), F.col("digest")).alias("hex"),
    ).mapInArrow(_base32, "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_length long, payload_digest string").write.format("warc").mode("append").save(path)


def _base32(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        digest = [x and base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column(6).to_pylist()]
        yield pa.record_batch([*batch.columns[:6], pa.array(digest, pa.string())], names=[*batch.schema.names[:6], "payload_digest"])


def archived(pages: DataFrame) -> DataFrame:
    """Writes the pages to an archive in the shared folder and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payloads' digests and revisits by their headers alone; either filter is pushed
    down. A null id stays null, null html is the empty payload, repeated rows are records of their own, an empty
    table is an empty archive, and other columns are not looked at. Ids keep their type.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_pages(pages, path)
    load = lambda kind, mode: spark.read.format("warc").option("payload", mode).load(path).where(F.col("record_type") == kind)
    back = load("response", "digest").unionByName(load("revisit", "none"))
    named = lambda c: F.nullif(F.regexp_extract(c, r"(?s)^<urn:page:(.*)>$", 1), F.lit("")).try_cast(pages.schema["page_id"].dataType)
    return back.select(named("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", named("refers_to").alias("refers_to"))
