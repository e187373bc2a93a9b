"""WARC archives: a Spark data source that reads them, and a writer that dedups payloads into revisits.

Each file is a series of gzip members, one per record. A member says in its gzip header (extra
field "sl", the format's own skip lengths) how long it is, packed and unpacked. Reading plans a
partition per file, takes record-type and header predicates from the query (=, IN, comparisons,
null tests on header columns), inflates no more than a record's headers first, and decodes a payload
only where the query asks for that column and the record passed; otherwise it goes on at the next member,
and what lies between is neither inflated nor, beyond a read-ahead, read. Members of other writers, without
the field, are inflated and thrown away in slices. Responses carry an HTTP header block before the payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from millrace.llm.files import list_files, open_fs, write_atomic
from millrace.llm.skew import hot_limit
from millrace.session import bounded_batches, materialise, shared_path
from millrace.llm.worker import owns

SUFFIX = ".warc.gz"
#: Fixed values of the format: version line and the profile of revisits with an identical payload.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DDL = "record_type string, record_id string, target_uri string, payload_digest string, payload_bytes long, refers_to string, content_type string, content_length long, headers map<string,string>, payload binary"
COLUMN_HEADER = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "payload_bytes": "x-payload-length",
    "refers_to": "warc-refers-to", "content_type": "content-type", "content_length": "content-length",
}
WHOLE = ("payload_bytes", "content_length")


SKIP = struct.Struct("<4BI2BH2sHII")  # gzip magic, method, flags, time, extra flags, system, extra bytes; sl: its bytes, packed and unpacked length
SKIP_FIELD = (b"sl", 8)
HTTP = "application/http"


def member(record: bytes, level: int = 3) -> bytes:
    """One gzip member whose header tells its packed and unpacked length (zero where a length takes more than 32 bits)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    total = SKIP.size + len(body)
    known = max(total, len(record)) < 1 << 32
    return SKIP.pack(0x1F, 0x8B, 8, 4, 0, 0, 255, 12, *SKIP_FIELD, total if known else 0, len(record) if known else 0) + body


class RecordStream:
    """Records of one gzip-member file: ``headers`` of the next, then ``payload`` or ``skip`` for its rest. ``inflated`` counts the bytes unpacked."""

    def __init__(self, file, chunk: int = 1 << 18):
        self.file, self.chunk, self.size = file, chunk, file.size()
        self.at, self.raw, self.raw_at = 0, b"", 0  # start of the member; bytes read and where they lie in the file
        self.inflated = 0

    def _read(self, at: int, n: int) -> bytes:
        """At least ``n`` bytes from ``at`` on where the file has them, and what was read beyond."""
        lo = at - self.raw_at
        if lo < 0 or lo + n > len(self.raw):
            kept = self.raw[lo:] if 0 <= lo < len(self.raw) else b""
            self.raw, self.raw_at = kept + self.file.read_at(max(n - len(kept), self.chunk), at + len(kept)), at
            lo = 0
        return self.raw[lo:]

    def _more(self, most: int | None = None) -> bool:
        """Inflate some more of the current member, ``most`` bytes at most; False at its end."""
        while not self.inflate.eof:
            rest = self.inflate.unconsumed_tail
            if not rest:
                rest = self._read(self.next, 1)
                if not rest:
                    raise ValueError("a record ends early")
                self.next += len(rest)
            found = self.inflate.decompress(rest, most or self.chunk)
            if found:
                self.inflated += len(found)
                self.text += found
                return True
        return False

    def headers(self) -> dict[str, str] | None:
        """Headers by lower-case name, or None at the end of the file."""
        if self.at >= self.size:
            return None
        head = self._read(self.at, SKIP.size)[: SKIP.size]
        self.length = 0
        if len(head) == SKIP.size:
            *start, extra, kind, n, packed, _ = SKIP.unpack(head)
            if start[3] & 4 and extra == 12 and (kind, n) == SKIP_FIELD:
                self.length = packed
        self.inflate, self.text, self.next = zlib.decompressobj(31), b"", self.at
        while b"\r\n\r\n" not in self.text:
            if not self._more(1024):
                raise ValueError("no end of headers")
        head, self.text = self.text.split(b"\r\n\r\n", 1)
        lines = head.split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError("no WARC record")
        out: dict[str, str] = {}
        for line in lines[1:]:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out[name.strip().lower()] = value.strip()
        self.left = int(out["content-length"])
        self.http = out.get("content-type", "").startswith(HTTP)
        return out

    def payload(self) -> bytes:
        """The record's block, without its HTTP headers."""
        parts, have = [self.text], len(self.text)
        while have < self.left:
            self.text = b""
            if not self._more():
                raise ValueError("a payload ends early")
            parts.append(self.text)
            have += len(self.text)
        block = b"".join(parts)[: self.left]
        self.skip()
        if not self.http:
            return block
        _, mark, body = block.partition(b"\r\n\r\n")
        if not mark:
            raise ValueError("no end of HTTP headers")
        return body

    def skip(self) -> None:
        """On to the next member: by its length where that is known, else by inflating the rest."""
        if self.length:
            self.at += self.length
            return
        self.text = b""
        while self._more():
            self.text = b""
        self.at = self.next - len(self.inflate.unused_data)


class _Whole(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _value(headers: dict[str, str], column: str) -> Any:
    found = headers.get(COLUMN_HEADER[column])
    if found is not None and column == "payload_digest":
        found = found.rpartition(":")[2]
    return int(found) if found is not None and column in WHOLE else found


_TESTS = {
    EqualTo: lambda v, x: v is not None and v == x,
    In: lambda v, x: v is not None and v in x,
    GreaterThan: lambda v, x: v is not None and v > x,
    GreaterThanOrEqual: lambda v, x: v is not None and v >= x,
    LessThan: lambda v, x: v is not None and v < x,
    LessThanOrEqual: lambda v, x: v is not None and v <= x,
    IsNull: lambda v, x: v is None,
    IsNotNull: lambda v, x: v is not None,
}


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        unknown = set(self.names) - {*COLUMN_HEADER, "headers", "payload"}
        if unknown:
            raise ValueError(f"no such column of a WARC record: {sorted(unknown)}")
        self.path = options["path"]
        self.tests: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and column in COLUMN_HEADER:
                self.tests.append((column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Whole(path) for path, _ in list_files(self.path, SUFFIX)] or [_Whole("")]

    def read(self, partition: _Whole) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kinds = {"payload": pa.binary(), "headers": pa.map_(pa.string(), pa.string())} | dict.fromkeys(WHOLE, pa.int64())
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        system, path = open_fs(partition.path)
        with system.open_input_file(path) as file:
            records, rows, size = RecordStream(file), [], 0
            while (headers := records.headers()) is not None:
                if not all(_TESTS[kind](_value(headers, c), x) for c, kind, x in self.tests):
                    records.skip()
                    continue
                body = None
                if "payload" in self.names:
                    body = records.payload()
                    size += len(body)
                else:
                    records.skip()
                rows.append([body if n == "payload" else list(headers.items()) if n == "headers" else _value(headers, n) for n in self.names])
                size += 200
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; with ``.schema(...)`` of fewer columns, the others are never made."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> WarcReader:
        return WarcReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, folder: str, columns: str | None = None) -> DataFrame:
    """Records below ``folder``; ``columns`` is a DDL of the columns wanted."""
    register(spark)
    reader = spark.read.format("warc")
    return (reader.schema(columns) if columns else reader).load(folder)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def urn_page(column):
    """The page of a record identifier, as a column."""
    return F.regexp_extract(column, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def record(page: int | None, url: str | None, body: bytes, owner: int | None, least: int) -> bytes:
    """One gzip member. The page is a revisit of ``owner`` if that is another page and the payload has ``least`` bytes."""
    revisit = owner is not None and owner != page and len(body) >= least
    lines = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"), f"WARC-Record-ID: {page_urn(page)}".encode()]
    if url is not None:
        # a header is one line: control characters are percent-encoded
        lines.append(b"WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url).encode())
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(body)}".encode(), f"X-Payload-Length: {len(body)}".encode()]
    if revisit:
        lines += [f"WARC-Refers-To: {page_urn(owner)}".encode(), f"WARC-Profile: {PROFILE}".encode()]
        body = b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if revisit else f"Content-Length: {len(body)}\r\n".encode()) + b"\r\n" + body
    lines += [f"Content-Type: {HTTP};msgtype=response".encode(), f"Content-Length: {len(block)}".encode()]
    return member(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n")


WRITTEN_DDL = "path string, records long, bytes long"


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per row; of equal payloads of at least ``least`` bytes the smallest identifier is the response.

    Returns path, records and bytes of each file; a task that runs again replaces its files whole.
    Null html is an empty payload; a null url leaves that header out. Rows that repeat the
    smallest identifier are all responses; a null identifier is never smallest unless a
    payload has no other, and then its rows are responses. Equality is by SHA-256 and length.
    An empty table writes nothing; further columns are ignored.
    """
    bounded_batches(df.sparkSession)
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("body"))
    keyed = base.withColumn("digest", F.unhex(F.sha2("body", 256)))
    owners = materialise(base.select("id", F.unhex(F.sha2("body", 256)).alias("digest")).groupBy("digest").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")), "warc-owners")
    # a payload of very many pages is broadcast with its owner (fewer than 1,000 are), and its pages are dealt by identifier
    limit = hot_limit(owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot = owners.where(F.col("n") > limit).select("digest", F.col("owner").alias("hot_owner"), F.lit(True).alias("hot"))
    dealt = keyed.join(F.broadcast(hot), "digest", "left").withColumn("at", F.when(F.col("hot"), F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256).cast("binary")).otherwise(F.col("digest")))
    rows = dealt.join(owners.where(F.col("n") <= limit).select(F.col("digest").alias("at"), "owner"), "at", "left").select("id", "url", "body", F.when(F.col("hot"), F.col("hot_owner")).otherwise(F.col("owner")).alias("owner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns("warc")
        context = TaskContext.get()
        records = ((i, u, b, o) for batch in batches for i, u, b, o in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()))
        ahead, part = next(records, None), 0
        while ahead is not None:
            made = [0, 0]

            def parts():
                nonlocal ahead
                while ahead is not None and made[1] < file_bytes:
                    data = record(*ahead, least)
                    made[0] += 1
                    made[1] += len(data)
                    yield data
                    ahead = next(records, None)

            path = write_atomic(folder, f"part-{context.partitionId():06d}-{part:04d}{SUFFIX}", str(context.taskAttemptId()), parts())
            part += 1
            yield pa.record_batch([pa.array([path]), pa.array([made[0]], pa.int64()), pa.array([made[1]], pa.int64())], names=["path", "records", "bytes"])

    return rows.mapInArrow(run, WRITTEN_DDL)


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_id, payload_digest, payload_bytes, payload) -> record_id and, from the payload itself, payload_digest and payload_bytes; a header that says otherwise is an error."""
    owns("warc")
    for batch in batches:
        found = [(sha1_base32(p), len(p)) for p in batch.column(3).to_pylist()]
        for record_id, digest, n, own in zip(*(batch.column(i).to_pylist() for i in range(3)), found):
            if (digest, n) != own:
                raise ValueError(f"the payload of {record_id} is not what its headers say")
        yield pa.record_batch([batch.column(0), pa.array([d for d, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["record_id", "payload_digest", "payload_bytes"])


def archive(df: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write ``df`` as archives and read all records back: responses with their payloads, from which digest and length are made anew, revisits by their headers only (both record types are predicates of the source)."""
    spark = df.sparkSession
    folder = folder or shared_path(spark, "warc")
    materialise(write_warc(df, folder, **columns), "warc-files")
    full = read_warc(spark, folder, "record_type string, record_id string, payload_digest string, payload_bytes long, payload binary").where("record_type = 'response'")
    read = full.select("record_id", "payload_digest", "payload_bytes", "payload").mapInArrow(_read_digests, "record_id string, payload_digest string, payload_bytes long")
    heads = read_warc(spark, folder, "record_type string, record_id string, payload_digest string, payload_bytes long, refers_to string").where("record_type = 'revisit'")
    return read.select(F.lit("response").alias("record_type"), "record_id", "payload_digest", "payload_bytes", F.lit(None).cast("string").alias("refers_to")).unionByName(heads)
