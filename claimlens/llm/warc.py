"""WARC archives as a PySpark data source, format ``warc``.

Reading plans one partition for each range of a file, tells record types and
target addresses apart by their headers before anything else is decoded, and
skips the payloads of records (or of whole reads) that do not want them.
Members are compressed one record each and carry the ``sl`` field of the WARC
standard's gzip annex: their compressed length, so a skipped record costs one seek.

Archives without that field, such as a crawler's, are read too: each by one task, which finds the
members' ends by inflating them.  Of archives written here readers take those that a commit's
manifest names, so what a failed or repeated task attempt wrote is never read.

Pushed down: equality and ``in`` on ``record_type``, ``target_uri``, ``record_id``,
``payload_digest`` and ``page_id``.  Without a ``payload`` column in the read's
schema no payload is decoded.

``write_pages`` and ``page_records`` archive a table of pages with revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In,
                                    InputPartition, WriterCommitMessage)

from claimlens.session import scratch_path

#: Bytes of a file that one task reads.
RANGE = 64 << 20
#: A member's start: gzip magic, deflate, flags = FEXTRA; then 6 bytes; then an extra field that begins with 'sl'.
_MAGIC = b"\x1f\x8b\x08\x04"
_HEAD = struct.Struct("<4sIBBH2sHII")  # magic, time, flags, system, extra length, 'sl', 8, compressed, plain

SCHEMA = ("record_type string, record_id string, page_id long, target_uri string, warc_date string, "
          "payload_digest string, payload_bytes long, refers_to long, payload binary")
_PUSHED = {"record_type", "target_uri", "record_id", "payload_digest", "page_id"}


# ---------------------------------------------------------------- files

def _fs(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    """pyarrow wants file:///x, Hadoop also writes file:/x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member with its lengths in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = _HEAD.size + len(body) + len(tail)
    return _HEAD.pack(_MAGIC, 0, 0, 255, 12, b"sl", 8, size, len(record) & 0xFFFFFFFF) + body + tail


def _text(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, date: str, uri: str, digest: str, http: bytes, payload: bytes,
           refers_to: str | None = None) -> bytes:
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: <{record_id}>".encode(), f"WARC-Date: {date}".encode(),
            f"WARC-Target-URI: {_text(uri)}".encode("utf-8", "replace"), f"WARC-Payload-Digest: sha1:{digest}".encode(),
            b"Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}".encode()]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{refers_to}>".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


PAGE_URN = "urn:page:"


def _page(urn: str | None) -> int | None:
    n = (urn or "").strip("<>").removeprefix(PAGE_URN)
    return int(n) if n.lstrip("-").isdigit() else None


# ---------------------------------------------------------------- reading

@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int
    size: int

    def __init__(self, path: str, start: int, stop: int, size: int):
        super().__init__((path, start, stop, size))
        self.path, self.start, self.stop, self.size = path, start, stop, size


def _headers(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return out


def _begins(file, left: int) -> bytes:
    """The first five plain bytes of the deflate body of at most ``left`` bytes at the file's place; fewer if it is none.

    A block's code tables alone can take some hundred bytes before the first plain one.
    """
    inflate, out = zlib.decompressobj(-15), b""
    while len(out) < 5 and left > 0 and not inflate.eof:
        raw = file.read(min(512, left))
        if not raw:
            break
        left -= len(raw)
        try:
            out += inflate.decompress(raw, 5 - len(out))
        except zlib.error:
            break
    return out


def _first_member(file, start: int, size: int) -> int:
    """The first record's place at or after ``start``: the magic bytes, then lengths and a record that hold."""
    if start == 0:
        return 0
    at, held = start, b""
    while at < size:
        file.seek(at)
        held = file.read(1 << 20)
        i = held.find(_MAGIC)
        while i >= 0:
            file.seek(at + i)
            head = file.read(_HEAD.size)
            if len(head) == _HEAD.size:
                magic, _, _, _, extra, name, n, packed, _ = _HEAD.unpack(head)
                if name == b"sl" and extra == 12 and n == 8 and at + i + packed <= size \
                        and _begins(file, packed - _HEAD.size) == b"WARC/":
                    return at + i
            i = held.find(_MAGIC, i + 1)
        at += len(held) - len(_MAGIC) if len(held) > len(_MAGIC) else len(held)
        if len(held) <= len(_MAGIC):
            break
    return size


class _Reader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.fieldNames()
        self.path = _uri(options["path"])
        self.range = int(options.get("rangebytes", RANGE))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = getattr(f, "attribute", (None,))
            if isinstance(f, (EqualTo, In)) and len(name) == 1 and name[0] in _PUSHED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name[0]] = self.wanted.get(name[0], values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs
        system, at = _fs(self.path)
        info = system.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        committed = {name for f in files if f.base_name.startswith(_MANIFEST)
                     for name in system.open_input_stream(f.path).readall().decode().split()}
        # of archives that this source wrote only those that a commit names: another attempt's file is no archive
        found = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.size and f.path.endswith((".warc.gz", ".warc"))
                       and (info.type == fs.FileType.File or f.base_name in committed or not _OWN.fullmatch(f.base_name)))
        return [Range(p, a, min(a + (self.range if p.endswith(".gz") else n), n), n)
                for p, n in found for a in range(0, n, self.range if p.endswith(".gz") else n)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:  # no files: Spark asks for one read without a partition
            return
        system, _ = _fs(self.path)
        rows: list[dict] = []
        held = 0
        with system.open_input_file(part.path) as file:
            if not part.path.endswith(".gz"):
                records = _plain(file, part)
            elif _has_lengths(file):
                records = _members(file, part)
            else:  # members without a length field: the first range's task reads the whole file
                records = _foreign(file, part) if part.start == 0 else ()
            for head, more in records:
                row = self._row(_headers(head), more)
                if row is not None:
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _row(self, h: dict[str, str], more) -> dict | None:
        row = {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id", "").strip("<>") or None,
               "page_id": _page(h.get("warc-record-id")), "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"),
               "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
               "refers_to": _page(h.get("warc-refers-to"))}
        if any(row[k] not in values for k, values in self.wanted.items()):
            return None
        if "payload_bytes" in self.names or "payload" in self.names:
            http, length = b"", int(h.get("content-length", 0))
            if h.get("content-type", "").startswith("application/http"):
                http = more(b"\r\n\r\n", length)
            declared = _headers(http).get("content-length") if http else None
            row["payload_bytes"] = int(declared) if declared and declared.isdigit() else length - len(http)
            if "payload" in self.names:
                row["payload"] = more(None, length - len(http)) if row["record_type"] != "revisit" else None
        return row

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
        return pa.record_batch([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in self.names], names=self.names)


class _Stream:
    """Decodes a record only as far as it is asked for."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.taken = chunks, bytearray(), 0

    def __call__(self, until: bytes | None, size: int) -> bytes:
        """The bytes through ``until``, or ``size`` bytes; fewer at the end."""
        seen = 0
        while True:
            end = None
            if until is not None:
                found = self.held.find(until, seen)
                end = found + len(until) if found >= 0 else None
                seen = max(0, len(self.held) - len(until or b"") + 1)
            elif len(self.held) >= size:
                end = size
            chunk = b"" if end is not None else next(self.chunks, b"")
            if end is not None or not chunk:
                end = len(self.held) if end is None else end
                out = bytes(self.held[:end])
                del self.held[:end]
                self.taken += end
                return out
            self.held += chunk


def _members(file, part: Range):
    at = _first_member(file, part.start, part.size)
    while at < part.stop:
        file.seek(at)
        magic, _, _, _, _, name, _, packed, _ = _HEAD.unpack(file.read(_HEAD.size))
        if magic != _MAGIC or name != b"sl":
            raise ValueError(f"{part.path}: no record with a length field at byte {at}")

        def chunks(left=packed - _HEAD.size):
            inflate, step = zlib.decompressobj(-15), 2048
            while left > 0 and not inflate.eof:
                raw = file.read(min(step, left))
                if not raw:
                    raise EOFError(f"{part.path}: the record at byte {at} is cut off")
                left, step = left - len(raw), 1 << 18
                yield inflate.decompress(raw)

        stream = _Stream(c for c in chunks() if c)
        yield stream(b"\r\n\r\n", 0), stream
        at += packed


def _has_lengths(file) -> bool:
    """Whether the file's first gzip member states its length, as this source writes them."""
    file.seek(0)
    head = file.read(_HEAD.size)
    if len(head) < _HEAD.size:
        return False
    magic, _, _, _, _, name, *_ = _HEAD.unpack(head)
    return magic == _MAGIC and name == b"sl"


def _foreign(file, part: Range):
    """The records of any gzip file, whether each is a member or a member holds many: a member ends where inflating it ends."""
    file.seek(0)
    rest = file.read(1 << 18)

    def chunks():
        nonlocal rest
        while rest:
            inflate = zlib.decompressobj(31)
            while not inflate.eof:
                raw, rest = rest or file.read(1 << 18), b""
                if not raw:
                    out = inflate.flush()
                    if not inflate.eof:
                        raise EOFError(f"{part.path}: the last member is cut off")
                    yield out
                # bounded pieces, however well the member is packed
                while raw and not inflate.eof:
                    out = inflate.decompress(raw, 1 << 20)
                    raw = inflate.unconsumed_tail
                    if out:
                        yield out
            rest = inflate.unused_data.lstrip(b"\0") or file.read(1 << 18)

    stream = _Stream(chunks())
    while True:
        head = stream(b"\r\n\r\n", 0)
        if not head.strip():
            return
        if not head.lstrip().startswith(b"WARC/"):
            raise ValueError(f"{part.path}: no record where one should begin")
        end = stream.taken + int(_headers(head.lstrip()).get("content-length", 0)) + 4
        yield head.lstrip(), stream
        while stream.taken < end and stream(None, min(1 << 20, end - stream.taken)):
            pass


def _plain(file, part: Range):
    at = 0
    while at < part.size:
        file.seek(at)

        def chunks():
            while raw := file.read(4096):
                yield raw

        stream = _Stream(chunks())
        head = stream(b"\r\n\r\n", 0)
        if not head.startswith(b"WARC/"):
            raise ValueError(f"{part.path}: no record at byte {at}")
        length = int(_headers(head).get("content-length", 0))
        yield head, stream
        at += len(head) + length + 4


# ---------------------------------------------------------------- writing

@dataclass
class _Done(WriterCommitMessage):
    path: str


#: Names of archives that this source writes; they count once a manifest names them.
_OWN = re.compile(r"part-[0-9a-f]{32}-[0-9a-f]{32}\.warc\.gz")
_MANIFEST = "_manifest-"


class _Writer(DataSourceArrowWriter):
    """One archive for each attempt of a task, under a name of its own.

    ``commit`` writes a manifest of the finished tasks' archives, which readers go by, and removes what
    failed or repeated attempts left; what an attempt leaves later still is in no manifest."""

    def __init__(self, options):
        self.path = _uri(options["path"])
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Done:
        system, at = _fs(self.path)
        system.create_dir(at, recursive=True)
        name = f"part-{self.job}-{uuid.uuid4().hex}.warc.gz"
        with system.open_output_stream(f"{at}/{name}", compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    r = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                    out.write(member(_page_record(r, self.date)))
        return _Done(name)

    def _clear(self, keep: set[str]) -> None:
        from pyarrow import fs
        system, at = _fs(self.path)
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.job}-") and f.base_name not in keep:
                system.delete_file(f.path)

    def commit(self, messages) -> None:
        system, at = _fs(self.path)
        system.create_dir(at, recursive=True)
        names = sorted(m.path for m in messages if m is not None)
        with system.open_output_stream(f"{at}/{_MANIFEST}{self.job}", compression=None) as out:
            out.write("".join(f"{n}\n" for n in names).encode())
        self._clear(set(names))

    def abort(self, messages) -> None:
        self._clear(set())


def _page_record(r: dict, date: str) -> bytes:
    payload = (r["html"] or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = f"{PAGE_URN}{r['page_id']}" if r["page_id"] is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, (r['url'] or '') + digest)}"
    first = r["refers_to"]
    return record("response" if first is None else "revisit", own, date, r["url"] or "", digest, http,
                  payload if first is None else b"", None if first is None else f"{PAGE_URN}{first}")


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)`` after ``register(spark)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(schema, self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---------------------------------------------------------------- pages

def page_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): ``refers_to`` is null for responses.

    Of rows with equal payloads of at least ``least`` bytes the smallest page_id is the response.
    Only digests are grouped; the few pages that revisit another are then joined to their rows
    by page_id and digest, so pages that repeat one payload spread over all tasks.

    Null html is the empty payload; a page with a null id is a response only if no page with
    its payload has an id; rows that repeat page_id and payload are all what the first one is.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")) \
        .withColumn("digest", F.sha1("html"))
    long_enough = p.filter(F.octet_length("html") >= least).select("page_id", "digest")
    first = long_enough.groupBy(F.col("digest").alias("f_digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = long_enough.distinct().join(first, F.col("digest") == F.col("f_digest")) \
        .filter(~F.col("page_id").eqNullSafe(F.col("first"))) \
        .select(F.col("page_id").alias("a_page"), F.col("digest").alias("a_digest"), "first")
    return p.join(again, F.col("page_id").eqNullSafe(F.col("a_page")) & (F.col("digest") == F.col("a_digest")), "left") \
        .select("page_id", "url", "html", F.col("first").alias("refers_to"))


def write_pages(pages: DataFrame, path: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    register(pages.sparkSession)
    page_records(pages, least).write.format("warc").mode("append").option("date", date).save(path)


def archive_digest(pages: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of op6: write archives, read their headers back."""
    spark = pages.sparkSession
    out = path or scratch_path(spark, "warc")
    write_pages(pages, out)
    wanted = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return spark.read.format("warc").schema(wanted).load(out).filter(F.col("record_type").isin("response", "revisit"))
