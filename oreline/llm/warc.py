"""WARC archives as a PySpark Python data source.

`spark.dataSource.register(WarcSource)`, then `df.write.format("warc")` and
`spark.read.format("warc").load(path)`. Records are gzip members of their own, each
with the `sl` extra field that holds its compressed and full length, so a reader
inflates the header block of a record, judges type and header predicates, and
steps over a payload that nobody wants without inflating it.

Reader options: path; payload (default true: false leaves `payload` null and
inflates headers only); verify (default false: recompute the digest of each
payload and fail on a difference); split_bytes (default 64 MB: larger compressed
files are read as several ranges; a record belongs to the range of its first byte).
Filters on record_type, target_uri, payload_digest, refers_to, record_id, page_id
and payload_length are pushed down and judged on headers.

Writer: one file for each task, under a name of its own attempt; commit writes a
manifest with the files of the attempts that won, and readers follow it, so lost
or repeated attempts leave nothing behind that is read.

Defined results: a null payload is written as an empty one; null urls and ids
leave their header out and are read as null. Control characters in a url are
percent-escaped. An empty table makes an archive without files and reads as no
rows. Other columns are ignored by the writer.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage,
)

from .shared import folder

SCHEMA = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_length", T.LongType()), T.StructField("refers_to", T.LongType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType()),
])
PAGE_URN = "urn:x-page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "_files.json"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(record_type: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, sha: str) -> bytes:
    """One WARC/1.1 record around an HTTP response; a revisit holds the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    ident = f"{PAGE_URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{sha}")
    if record_type == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <{PAGE_URN}{refers_to}>", "WARC-Truncated: length"]
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member with the skip-length extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(raw) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x04\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _page(value: str | None) -> int | None:
    value = (value or "").strip("<>")
    return int(value[len(PAGE_URN) :]) if value.startswith(PAGE_URN) else None


def columns_of(head: dict[str, str]) -> dict:
    sha = head.get("warc-payload-digest")
    return {
        "record_id": head.get("warc-record-id", "").strip("<>") or None, "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "page_id": _page(head.get("warc-record-id")),
        "payload_digest": sha.removeprefix("sha1:") if sha else None, "payload_length": int(head["x-payload-length"]) if "x-payload-length" in head else None, "refers_to": _page(head.get("warc-refers-to")), "headers": head,
    }


def payload_of(block: bytes, head: dict[str, str]) -> bytes:
    if head.get("content-type", "").startswith("application/http"):
        return block.split(b"\r\n\r\n", 1)[1] if b"\r\n\r\n" in block else b""
    return block


def accepts(test: Filter, row: dict) -> bool:
    value = row[test.attribute[0]]
    match test:
        case IsNull():
            return value is None
        case IsNotNull():
            return value is not None
        case EqualNullSafe():
            return value == test.value
    if value is None:
        return False
    match test:
        case EqualTo():
            return value == test.value
        case In():
            return value in test.value
        case GreaterThan():
            return value > test.value
        case GreaterThanOrEqual():
            return value >= test.value
        case LessThan():
            return value < test.value
        case LessThanOrEqual():
            return value <= test.value
        case StringStartsWith():
            return value.startswith(test.value)
        case StringEndsWith():
            return value.endswith(test.value)
        case StringContains():
            return test.value in value
    return True


PUSHED = (IsNull, IsNotNull, EqualNullSafe, EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class Window:
    """Buffered reads of a file, by absolute place."""

    CHUNK = 4 << 20

    def __init__(self, handle, size: int):
        self.handle, self.size, self.at, self.data = handle, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.data):
            self.handle.seek(at)
            self.at, self.data = at, self.handle.read(max(n, self.CHUNK))
        return self.data[at - self.at : at - self.at + n]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        known = {f.name for f in SCHEMA} - {"headers", "payload"}
        for test in filters:
            if isinstance(test, PUSHED) and len(test.attribute) == 1 and test.attribute[0] in known:
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Range]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pafs.FileType.File:
            files = [info]
        else:
            files = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.base_name.endswith((".warc", ".warc.gz"))]
            marker = f"{root}/{MANIFEST}"
            if fs.get_file_info(marker).type == pafs.FileType.File:
                with fs.open_input_stream(marker) as f:
                    named = set(json.loads(f.read()))
                files = [f for f in files if f.base_name in named]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            step = self.split if f.path.endswith(".gz") else max(f.size, 1)
            out += [Range(f.path, at, min(at + step, f.size), f.size) for at in range(0, f.size, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(partition.path) as handle:
            window = Window(handle, partition.size)
            walk = self._packed if partition.path.endswith(".gz") else self._plain
            for row in walk(window, partition):
                rows.append(row)
                held += 400 + len(row["payload"] or b"")
                if held > 8 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_length": pa.int64(), "refers_to": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([list(r[f.name].items()) if f.name == "headers" else r[f.name] for r in rows], kinds.get(f.name, pa.string())) for f in SCHEMA], names=SCHEMA.names)

    def _row(self, head: dict[str, str], block) -> dict | None:
        row = columns_of(head)
        if not all(accepts(t, row) for t in self.tests):
            return None
        row["payload"] = None
        if (self.payload or self.verify) and row["record_type"] != "revisit":
            body = payload_of(block(), head)
            if self.verify and row["payload_digest"] and (digest(body) != row["payload_digest"] or row["payload_length"] not in (None, len(body))):
                raise ValueError(f"payload of {row['record_id']} differs from its digest")
            row["payload"] = body if self.payload else None
        return row

    def _packed(self, window: Window, part: Range) -> Iterator[dict]:
        at = part.start if part.start == 0 else self._next_member(window, part.start, part.end)
        while at is not None and at < part.end:
            fixed = window.get(at, 24)
            if fixed[:4] == b"\x1f\x8b\x08\x04" and fixed[12:14] == b"sl":
                length, full = struct.unpack("<II", fixed[16:24])
                body = window.get(at + 24, min(length - 32, 4096))
                inflate = zlib.decompressobj(-15)
                text = inflate.decompress(body, 2048)
                while b"\r\n\r\n" not in text and not inflate.eof:
                    if not inflate.unconsumed_tail and len(body) < length - 32:
                        body = window.get(at + 24, length - 32)
                        inflate = zlib.decompressobj(-15)
                        text = inflate.decompress(body, 2048)
                        continue
                    more = inflate.decompress(inflate.unconsumed_tail, 2048)
                    if not more and not inflate.unconsumed_tail:
                        raise ValueError(f"{part.path}: broken record at {at}")
                    text += more
                head = parse_head(text[: text.index(b"\r\n\r\n")])

                def block(at=at, length=length, head=head) -> bytes:
                    raw = zlib.decompress(window.get(at + 24, length - 32), -15)
                    start = raw.index(b"\r\n\r\n") + 4
                    return raw[start : start + int(head["content-length"])]
            else:  # a member without skip length has to be inflated to find its end
                raw, length = self._whole_member(window, at)
                start = raw.index(b"\r\n\r\n") + 4
                head = parse_head(raw[: start - 4])

                def block(raw=raw, start=start, head=head) -> bytes:
                    return raw[start : start + int(head["content-length"])]

            row = self._row(head, block)
            if row is not None:
                yield row
            at += length
            if window.size - at < 24:
                return

    @staticmethod
    def _whole_member(window: Window, at: int) -> tuple[bytes, int]:
        inflate, out, n = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            piece = window.get(at + n, 1 << 16)
            if not piece:
                raise ValueError("gzip member without an end")
            out.append(inflate.decompress(piece))
            n += len(piece) - len(inflate.unused_data)
        return b"".join(out), n

    @staticmethod
    def _next_member(window: Window, at: int, end: int) -> int | None:
        """The first record that starts at `at` or later and before `end`."""
        while at < end:
            chunk = window.get(at, 1 << 20)
            i = chunk.find(b"\x1f\x8b\x08")
            if i < 0:
                at += max(len(chunk) - 2, 1)
                continue
            try:
                if zlib.decompressobj(31).decompress(window.get(at + i, 512), 16).startswith(b"WARC/"):
                    return at + i if at + i < end else None
            except zlib.error:
                pass
            at += i + 1
        return None

    def _plain(self, window: Window, part: Range) -> Iterator[dict]:
        at = 0
        while at < part.size:
            lead = window.get(at, 2)
            if lead == b"\r\n":
                at += 2
                continue
            n = 4096
            while b"\r\n\r\n" not in (text := window.get(at, n)):
                if at + n >= part.size:
                    return
                n *= 2
            start = text.index(b"\r\n\r\n") + 4
            head = parse_head(text[: start - 4])
            size = int(head["content-length"])
            row = self._row(head, lambda a=at + start, s=size: window.get(a, s))
            if row is not None:
                yield row
            at += start + size


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 1)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out = None
        for batch in iterator:
            columns = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            get = lambda k, i: columns[k][i].as_py() if k in columns else None
            for i in range(batch.num_rows):
                payload = get("payload", i) or b""
                payload = payload.encode() if isinstance(payload, str) else bytes(payload)
                raw = record_bytes(get("record_type", i) or "response", get("page_id", i), get("target_uri", i), payload, get("refers_to", i), digest(payload))
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member(raw, self.level))
        if out:
            out.close()
        return Written([name] if out else [])

    def commit(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        marker = f"{root}/{MANIFEST}"
        old: list[str] = []
        if fs.get_file_info(marker).type == pafs.FileType.File:
            with fs.open_input_stream(marker) as f:
                old = json.loads(f.read())
        names = [n for m in messages if m for n in m.files]
        with fs.open_output_stream(marker) as f:
            f.write(json.dumps(names if self.overwrite else old + names).encode())
        for n in old if self.overwrite else []:
            fs.delete_file(f"{root}/{n}")

    def abort(self, messages: list) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for n in m.files if m else []:
                fs.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def deduplicated(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, salts: int = 32) -> DataFrame:
    """Rows for the writer: the smallest id of each payload is a response, the others revisit it.

    Only digests meet in the shuffle that finds equal payloads: they are counted
    before it, and the groups of copies are salted on the way back. The pages then
    get their targets by a join on their own ids. Payloads of fewer than `least`
    bytes are all responses. Rows with the same id and payload get the same type.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("target_uri"), F.coalesce(pages[html_col], F.lit("")).alias("payload"))
    key = F.sha1(F.col("payload").cast("binary"))
    marks = rows.select("page_id", key.alias("sha"), F.octet_length("payload").alias("size")).where((F.col("size") >= least) & F.col("page_id").isNotNull())
    groups = marks.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sha", F.col("first").alias("refers_to"))
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("salt", F.col("salt").cast("long"))
    links = marks.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts))).join(salted, ["sha", "salt"]).where("page_id <> refers_to").select("page_id", "sha", "refers_to").distinct()
    return (
        rows.withColumn("sha", key).join(links, ["page_id", "sha"], "left")
        .select("page_id", "target_uri", "payload", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to")
    )


def archive(pages: DataFrame, path: str | None = None, **columns: str) -> str:
    """Writes the pages as WARC files and returns where."""
    spark = pages.sparkSession
    register(spark)
    path = path or folder(spark, "warc")
    deduplicated(pages, **columns).write.format("warc").mode("append").option("path", path).save()
    return path


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)
