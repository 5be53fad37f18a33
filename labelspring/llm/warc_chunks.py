"""WARC archives through a table of payload chunks.

1. Every record becomes rows (record_id, chunk_no) with at most CHUNK bytes of its payload
   and the SHA-1 of the payload up to there, so the last chunk carries the digest of the
   whole.  Chunks are cuts of the batch's own buffer: no payload is copied or held twice,
   and from here on nothing ever needs a whole record in memory.
2. The last chunks give each record's length and digest.  Of equal payloads the record with
   the largest page_id is the response, the others become revisits of it.
3. Records meet their chunks by record_id, ordered inside a task, and are streamed into one
   archive a task: a header, then chunk after chunk.  A revisit has the HTTP header only.
4. Archives are read as a stream of the same chunk rows; digests are taken from the bytes
   read, and for a revisit from its header.

A file's name holds the attempt that wrote it, and the manifest lists the files of the
attempts that Spark accepted, so lost executors only cause files to be written again.

Defined cases: null html is an empty payload; a null page_id is the least of its group and
is archived without an id; rows with one page_id and one payload are all responses if it is
the largest; a null url leaves out the target.  An empty table writes nothing and gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm.arrow_tokens import open_folder
from labelspring.llm.common import written
from labelspring.operators.joins import join_groups
from labelspring.runtime import scratch_path

CHUNK = 64 << 10  # bytes of a chunk
BLOCK = 1 << 20  # bytes read from an archive, or given to Spark, at once
LEVEL = 1  # compression of the archives' members
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Fixed values of the format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"

CHUNK_SCHEMA = "record_id long, page_id long, url string, chunk_no long, data binary, total long, sha1 binary, last boolean"
_CHUNK_ARROW = pa.schema([
    ("record_id", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int64()),
    ("data", pa.binary()), ("total", pa.int64()), ("sha1", pa.binary()), ("last", pa.bool_()),
])


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[list] = [[] for _ in _CHUNK_ARROW]
            held = 0
            for page, url, payload in zip(ids, urls, batch.column(2)):
                whole = memoryview(payload.as_buffer())
                digest = hashlib.sha1()
                count = max(1, -(-len(whole) // size))
                for n in range(count):
                    part = whole[n * size : (n + 1) * size]
                    digest.update(part)
                    values = record, page, url if n == 0 else None, n, part, min((n + 1) * size, len(whole)), digest.digest(), n == count - 1
                    for column, value in zip(rows, values):
                        column.append(value)
                    held += len(part)
                    if held >= BLOCK:
                        yield _batch(rows)
                        rows, held = [[] for _ in _CHUNK_ARROW], 0
                record += 1
            yield _batch(rows)

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _CHUNK_ARROW)], schema=_CHUNK_ARROW)


def chunk_table(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The written chunk table of ``pages`` (page_id, url, html); writing fixes the record ids."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    chunks = rows.mapInArrow(_chunks(size), CHUNK_SCHEMA)
    path = scratch_path(pages.sparkSession, "chunks")
    chunks.write.option("compression", "zstd").parquet(path)
    return pages.sparkSession.read.schema(chunks.schema).parquet(path)


def records_of(chunks: DataFrame, least: int = 0) -> DataFrame:
    """record_id, page_id, payload_bytes, sha1, refers_to, revisit of every record, as a written table.

    Payloads of fewer than ``least`` bytes are never revisits.
    """
    records = written(
        chunks.where("last").select("record_id", "page_id", F.col("total").alias("payload_bytes"), "sha1"), "records"
    )
    groups = written(
        records.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("members")), "payloads"
    )
    named = join_groups(records, groups, ["sha1", "payload_bytes"], "members")
    revisit = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    named = named.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("refers_to")))
    return written(named.select("record_id", "page_id", "payload_bytes", "sha1", "refers_to", "revisit"), "named")


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_name(page: int | None, record: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}{'' if record is None else f':{record}'}>"


def _page_of(name: str) -> int | None:
    page = name.strip("<>").split(":")[2]
    return int(page) if page else None


def _target(url: str) -> str:
    """A header value must stay on its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_header(record: int, page: int | None, url: str | None, length: int, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """WARC and HTTP headers of a record, up to its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_name(page, record)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _target(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{base32(sha1)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_name(refers_to, None))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(http) + (0 if revisit else length))),
    ]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


class ArchiveWriter:
    """Streams records into one file; with a level, every record is a gzip member of its own."""

    def __init__(self, sink, level: int = LEVEL):
        self.sink, self.level, self.member = sink, level, None
        self.records = self.missing = 0

    def _put(self, data) -> None:
        self.sink.write(self.member.compress(data) if self.member else data)

    def begin(self, header: bytes, payload: int) -> None:
        self.end()
        self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31) if self.level else None
        self._put(header)
        self.missing, self.open = payload, True
        self.records += 1

    def add(self, data) -> None:
        self._put(data)
        self.missing -= len(data)

    def end(self) -> None:
        if not self.records or not self.open:
            return
        if self.missing:
            raise ValueError(f"a record lacks {self.missing} bytes of its payload")
        self._put(END)
        if self.member:
            self.sink.write(self.member.flush())
        self.open = False


def _write(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}.warc" + (".gz" if level else "")
        current = None
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            writer = ArchiveWriter(sink, level)
            batch = first
            while batch is not None:
                heads = batch.select(["record_id", "page_id", "url", "payload_bytes", "sha1", "refers_to", "revisit"]).to_pylist()
                for head, data in zip(heads, batch.column("data")):
                    if head["record_id"] != current:
                        current = head["record_id"]
                        length = 0 if head["revisit"] else head["payload_bytes"]
                        writer.begin(record_header(
                            current, head["page_id"], head["url"], head["payload_bytes"], head["sha1"], head["refers_to"], head["revisit"]
                        ), length)
                    if not head["revisit"]:
                        writer.add(memoryview(data.as_buffer()))
                batch = next(batches, None)
            writer.end()
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.records], pa.int64())], names=["name", "n_records"])

    return run


def write_archives(pages: DataFrame, folder: str, size: int = CHUNK, least: int = 0, level: int = LEVEL) -> DataFrame:
    """Archive ``pages`` in ``folder``; the manifest has name and n_records of each file."""
    chunks = chunk_table(pages, size)
    records = records_of(chunks, least)
    # of a revisit only the first chunk travels, for its url; its bytes do not
    wanted = chunks.select("record_id", "chunk_no", "url", "data")
    stream = records.select("record_id", "page_id", "payload_bytes", "sha1", "refers_to", "revisit").join(wanted, "record_id", "left")
    stream = stream.where("not revisit or chunk_no = 0")
    stream = stream.withColumn("data", F.expr("IF(revisit, CAST('' AS BINARY), data)"))
    ordered = stream.sortWithinPartitions("record_id", "chunk_no")
    return written(ordered.mapInArrow(_write(folder, level), "name string, n_records long"), "manifest")


class ArchiveReader:
    """Records of one archive as a stream of chunks.

    ``records()`` yields (fields, http_length, pieces): the WARC fields, the HTTP
    Content-Length, and an iterator of payload pieces, which may be left unread.
    """

    def __init__(self, source, size: int = CHUNK, packed: bool = True):
        self.source, self.size, self.packed = source, size, packed
        self.buffer, self.inflater, self.raw = bytearray(), None, b""

    def _more(self) -> bool:
        """Another block of plain bytes in the buffer; false at the end."""
        if not self.packed:
            block = self.source.read(BLOCK)
            self.buffer += block
            return bool(block)
        while True:
            if not self.raw:
                self.raw = self.source.read(BLOCK)
                if not self.raw:
                    # what the last block left inside the inflater
                    self.buffer += (plain := self.inflater.decompress(b"", BLOCK) if self.inflater and not self.inflater.eof else b"")
                    return bool(plain)
            if self.inflater is None or self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            plain = self.inflater.decompress(self.raw, BLOCK)
            self.raw = self.inflater.unconsumed_tail or self.inflater.unused_data
            if plain:
                self.buffer += plain
                return True

    def _until(self, mark: bytes) -> bytes:
        """Bytes up to ``mark``, which is taken too; empty at the end of the file."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer:
                    raise ValueError("an archive ends inside a header")
                return b""
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def _exactly(self, n: int) -> Iterator[bytes]:
        while n:
            while len(self.buffer) < min(n, self.size):
                if not self._more():
                    raise ValueError("an archive ends inside a record")
            part = bytes(self.buffer[: min(n, self.size)])
            del self.buffer[: len(part)]
            n -= len(part)
            yield part

    @staticmethod
    def _fields(block: bytes) -> dict[str, str]:
        lines = block.decode("utf-8", "surrogateescape").split("\r\n")[1:]
        return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}

    def records(self):
        while head := self._until(END):
            fields = self._fields(head)
            http = self._until(END)
            length = int(fields["content-length"]) - len(http) - len(END)
            pieces = self._exactly(length)
            yield fields, int(self._fields(http)["content-length"]), pieces
            for _ in pieces:
                pass
            for tail in self._exactly(len(END)):
                if tail != END:
                    raise ValueError("a record is not closed")


def _read(folder: str, size: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        for files in batches:
            for name in files.column(0).to_pylist():
                rows: list[list] = [[] for _ in _READ_ARROW]
                held = 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for fields, length, pieces in ArchiveReader(source, size, name.endswith(".gz")).records():
                        for row in _chunk_rows(fields, length, pieces, with_data):
                            for column, value in zip(rows, row):
                                column.append(value)
                            held += 300 + len(row[6] or b"")
                            if held >= BLOCK:
                                yield _read_batch(rows)
                                rows, held = [[] for _ in _READ_ARROW], 0
                yield _read_batch(rows)

    return run


_READ_ARROW = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()),
    ("stated_digest", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("total", pa.int64()), ("digest", pa.string()),
    ("last", pa.bool_()),
])
READ_SCHEMA = (
    "page_id long, record_type string, url string, refers_to long, stated_digest string, chunk_no long, data binary,"
    " total long, digest string, last boolean"
)


def _read_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _READ_ARROW)], schema=_READ_ARROW)


def _chunk_rows(fields: dict[str, str], length: int, pieces: Iterator[bytes], with_data: bool) -> Iterator[tuple]:
    """Chunk rows of a record; the digest of a response is that of the bytes read so far."""
    page, kind, url = _page_of(fields["warc-record-id"]), fields["warc-type"], fields.get("warc-target-uri")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        yield page, kind, url, _page_of(fields["warc-refers-to"]), stated, 0, b"" if with_data else None, length, stated, True
        return
    digest, total, n = hashlib.sha1(), 0, 0
    last = None
    for piece in pieces:
        if last is not None and with_data:
            yield last
        digest.update(piece)
        total += len(piece)
        ended = total == length
        # without the data only the last chunk is of use
        state = base32(digest.digest()) if with_data or ended else None
        last = page, kind, url, None, stated, n, piece if with_data else None, total, state, ended
        n += 1
    if last is None:
        last = page, kind, url, None, stated, 0, b"" if with_data else None, 0, base32(digest.digest()), True
    if last[7] != length or last[8] != stated:
        raise ValueError(f"the payload of page {page} does not have its stated length and digest")
    yield last


def read_chunks(manifest: DataFrame, folder: str, size: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Chunk rows of all archives; without data, one row (the last chunk) for each record."""
    files = manifest.select("name")
    dealt = files.repartition(max(1, files.count()), "name")
    return dealt.mapInArrow(_read(folder, size, with_data), READ_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks of every page, read back."""
    folder = folder or scratch_path(pages.sparkSession, "archives")
    rows = read_chunks(write_archives(pages, folder), folder, with_data=False)
    return rows.select(
        "page_id", F.col("total").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to",
        (F.col("chunk_no") + 1).alias("n_chunks"),
    )
