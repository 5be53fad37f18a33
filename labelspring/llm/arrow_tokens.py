"""Token ids in Arrow files of equal-length sequences.

The ids of all documents, each closed by an end id, form one stream in ascending
doc_id order.  A range of documents goes to one file: Arrow's file format, batches
of a fixed-size list ``ids`` (unsigned 16-bit where the vocabulary allows, else 32)
and a fixed-size list ``mask`` of booleans, false only in the padding of a file's
last sequence.  Uncompressed batches of fixed width give any sequence by
arithmetic on a memory map, without a copy.  A second file per range lists its
documents (doc_id, start in the file, n_tokens).

A file's name holds the attempt that wrote it, and the manifest has one row for each file of
an attempt that Spark accepted, so a lost executor's work is simply done again and files of
two attempts never mix.  The starts of files are sums over the manifest.

Defined cases: a null or empty text is the end id alone; null ids come first;
repeated ids are ordered by the hash of their text.  An empty table writes no file and
reads back as no rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelspring.llm.bpe import Encoder
from labelspring.llm.common import whole_text, written
from labelspring.runtime import scratch_path

LENGTH = 2048  # ids of a sequence
BATCH = 256  # sequences of a record batch
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = 50_257


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as a path or an address."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def sequence_schema(length: int, vocabulary: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into sequences and writes them batch by batch."""

    def __init__(self, sink, length: int = LENGTH, vocabulary: int = VOCABULARY):
        self.schema = sequence_schema(length, vocabulary)
        self.length, self.kind = length, self.schema.field("ids").type.value_type
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.kind.to_pandas_dtype()))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BATCH * self.length:
            flat = np.concatenate(self.parts)
            whole = len(flat) // (BATCH * self.length) * BATCH * self.length
            for i in range(0, whole, BATCH * self.length):
                self._batch(flat[i : i + BATCH * self.length], BATCH * self.length)
            self.parts, self.held = [flat[whole:].copy()], len(flat) - whole

    def _batch(self, flat: np.ndarray, used: int) -> None:
        mask = np.arange(len(flat)) < used
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.parts)
            self._batch(np.pad(flat, (0, -len(flat) % self.length)), len(flat))
        self.writer.close()


class SequenceReader:
    """Random access to one file; ``source`` is memory-mapped or an open file of any store."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self._kept: tuple[int, pa.RecordBatch] | None = None

    def _of(self, sequence: int) -> tuple[pa.RecordBatch, int]:
        n, row = divmod(sequence, BATCH)
        if self._kept is None or self._kept[0] != n:
            self._kept = n, self.file.get_batch(n)
        return self._kept[1], row

    def sequence(self, n: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence ``n``."""
        batch, row = self._of(n)
        return batch.column(0).slice(row, 1).flatten().to_numpy(), batch.column(1).slice(row, 1).flatten()

    def ids(self, start: int, count: int) -> np.ndarray:
        """Ids from ``start`` of the file's stream; a view where they lie in one batch."""
        parts = []
        while count > 0:
            n, at = divmod(start, BATCH * self.length)
            flat = self._of(n * BATCH)[0].column(0).flatten().to_numpy()
            part = flat[at : at + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _write(folder: str, length: int, end_id: int, tokenizer: str, vocabulary: int):
    end = np.array([end_id], dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next(batches, None)
        while batch is not None and not batch.num_rows:
            batch = next(batches, None)
        if batch is None:
            return
        encoder = Encoder.shared(tokenizer)
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, own = context.partitionId(), f"{context.taskAttemptId()}-{uuid.uuid4().hex}"
        rows, first = 0, None
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        name = f"part-{part:06d}-{own}"
        with store.open_output_stream(f"{root}/{name}.ids.arrow") as sink, store.open_output_stream(f"{root}/{name}.docs.arrow") as side:
            writer, index = SequenceWriter(sink, length, vocabulary), pa.ipc.new_file(side, index_schema)
            while batch is not None:
                starts, counts = [], []
                for text in batch.column(1):
                    ids = np.concatenate([np.frombuffer(encoder.encode(text.as_py()), dtype="<u4"), end])
                    starts.append(writer.total)
                    counts.append(len(ids))
                    writer.add(ids)
                rows += batch.num_rows
                index.write_batch(pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=index_schema
                ))
                batch = next(batches, None)
            writer.close()
            index.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([part], pa.int32()), pa.array([rows], pa.int64()), pa.array([writer.total], pa.int64())],
            names=["name", "part", "n_docs", "n_ids"],
        )

    return run


def write_tokens(
    docs: DataFrame, folder: str, length: int = LENGTH, end_id: int = END_ID, tokenizer: str = TOKENIZER,
    vocabulary: int = VOCABULARY,
) -> DataFrame:
    """Write the files and return the manifest: name, part, n_docs, n_ids, start (ids of earlier files)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = whole_text(docs, hashed=True).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text_hash")
    manifest = written(
        ordered.mapInArrow(_write(folder, length, end_id, tokenizer, vocabulary), "name string, part int, n_docs long, n_ids long"),
        "manifest",
    )
    # one row per file, so one partition holds them all
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")), "manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        local = isinstance(store, pafs.LocalFileSystem)
        for files in batches:
            for name, base in zip(files.column(0).to_pylist(), files.column(1).to_pylist()):
                place = f"{root}/{name}"
                ids_file = pa.memory_map(f"{place}.ids.arrow") if local else store.open_input_file(f"{place}.ids.arrow")
                docs_file = pa.memory_map(f"{place}.docs.arrow") if local else store.open_input_file(f"{place}.docs.arrow")
                reader, index = SequenceReader(ids_file), pa.ipc.open_file(docs_file)
                for n in range(index.num_record_batches):
                    rows = index.get_batch(n)
                    starts, counts = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                    crc = [zlib.crc32(reader.ids(int(s), int(c)).astype("<u4").tobytes()) for s, c in zip(starts, counts)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(starts + base), rows.column(2), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    files = manifest.select("name", "start", "part")
    spread = files.repartition(max(1, files.count()), "part").select("name", "start")
    return spread.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, spark: SparkSession) -> DataFrame:
    folder = scratch_path(spark, "token_files")
    return read_tokens(write_tokens(docs, folder), folder)
