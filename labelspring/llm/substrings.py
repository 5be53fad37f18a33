"""Removal of repeated byte strings of a fixed length, decided by external induced sorting.

A byte goes if a LENGTH-byte string that covers it also starts anywhere else.

1. Each string of LENGTH bytes selects the anchor among its GRAM-byte substrings: the
   one with the least hash, leftmost first.  Equal strings select equal anchors
   at equal places, so only strings of one anchor need comparing.  The strings of one
   anchor occurrence overlap in one stretch of text; a document becomes a short list of
   stretches (anchor, hash of the whole stretch, range of string starts).
2. Stretches whose anchor occurs once hold no repeated string.  Stretches of an anchor
   that are all equal are repeated as a whole.  Only where different stretches share
   an anchor, one representative of each is split into blocks of BLOCK starts.  The
   strings of a block have LENGTH - BLOCK + 1 bytes in common, its core; a block is the digest of
   its core and the few bytes before and behind it.
3. Blocks whose core no other block has are done, equal blocks are repeated as a whole, and one
   of each goes on.  Tasks sort the suffixes of their blocks by induced sorting
   (``induced_sort``), a core being one symbol: neighbours that have BLOCK symbols in common, the
   core among them, have LENGTH bytes in common.  The blocks of one core are sorted
   together, so a core with more than SHARD different symbols is not sorted: its single strings
   are grouped by Spark.  No task holds more than two shards.
4. Starts come together per document as ranges, are widened to bytes and cut out.

Text moves twice: the documents with stretches to sort, and those that lose bytes.  Joins on an
anchor, a stretch or a block keep hot ones spread.

Defined cases: null and empty texts, and texts below LENGTH bytes, lose nothing.
Rows repeated with one id and text are repeats of each other.  An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm import induced_sort, words
from labelspring.llm.common import whole_text, written
from labelspring.operators.joins import join_groups

LENGTH = 400
GRAM = 100
BLOCK = 8
SHARD = 1 << 19  # symbols that are gathered for one sort, and the most that one core brings to it
ROWS = 20_000  # blocks given to Spark at once
_U = np.uint64


class Hashes:
    """Content hashes of any stretch of one slice of bytes."""

    def __init__(self, data: np.ndarray):
        self.powers, self.inverse = words._tables(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(words._CODES[data] * self.inverse[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return words.mix((self.sums[end] - self.sums[start]) * self.powers[end] + (end - start).astype(_U))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=_U)
    padded[:n] = keys
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def stretches(begin: int, end: int, hashes: Hashes, length: int, gram: int):
    """(anchor place, first and last string start) of a document in bytes begin .. end of the slice, relative to it."""
    n = end - begin
    if n < length:
        return np.zeros((3, 0), np.int64)
    at = np.arange(begin, end - gram + 1)
    # the upper half of the hash decides, then the leftmost place
    keys = (hashes.of(at, at + gram) >> _U(32) << _U(32)) | np.arange(len(at), dtype=_U)
    chosen = (sliding_least(keys, length - gram + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    last = np.append(first[1:], len(chosen)) - 1
    return np.stack([chosen[first], first, last])


def _stretch_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in words.slices(batch.column(1)):
                hashes = Hashes(data)
                parts, rows, base = [], [], []
                for i in range(end - first):
                    s = stretches(int(offsets[i]), int(offsets[i + 1]), hashes, length, gram)
                    parts.append(s)
                    rows.append(np.full(s.shape[1], first + i))
                    base.append(np.full(s.shape[1], offsets[i]))
                place, low, high = np.concatenate(parts, axis=1)
                row, base = np.concatenate(rows).astype(np.int64), np.concatenate(base).astype(np.int64)
                anchor = hashes.of(base + place, base + place + gram)
                whole = hashes.of(base + low, base + high + length) ^ words.mix((place - low).astype(_U))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(2).take(take), pa.array(anchor.view(np.int64)),
                        pa.array(whole.view(np.int64)), pa.array(place), pa.array(low), pa.array(high),
                    ],
                    names=["doc_id", "text_hash", "anchor", "whole", "place", "low", "high"],
                )

    return run


_BLOCK_SCHEMA = pa.schema([
    ("anchor", pa.int64()), ("whole", pa.int64()), ("shift", pa.int32()), ("n_starts", pa.int32()),
    ("core", pa.binary()), ("before", pa.binary()), ("after", pa.binary()),
])


def _block_rows(length: int, block: int):
    """The blocks of each stretch: its first start (``shift``) and number of starts, core digest, bytes around the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in _BLOCK_SCHEMA]

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)

        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1)):
                data = text.as_buffer().to_pybytes()
                for w in wanted.as_py():
                    place = w["place"]
                    # blocks by the distance of the start before the anchor, so equal strings are in one block
                    far, near = place - w["low"], place - w["high"]
                    for b in range(near // block, far // block + 1):
                        low, high = place - min(far, b * block + block - 1), place - max(near, b * block)
                        # bytes that every string of a full block has
                        begin = place - b * block
                        end = begin - block + 1 + length
                        core = hashlib.blake2b(data[begin:end], digest_size=16, person=b.to_bytes(8, "little")).digest()
                        values = w["anchor"], w["whole"], low - w["low"], high - low + 1, core, data[low:begin], data[end : high + length]
                        for column, value in zip(out, values):
                            column.append(value)
                    if len(out[0]) >= ROWS:
                        yield rows()
                        out = [[] for _ in _BLOCK_SCHEMA]
        yield rows()

    return run


def repeated_starts(pieces: list, least: int) -> list[list[int]]:
    """For each piece (bytes or numbers) the starts whose ``least`` symbols start elsewhere in the pieces too, by suffix order."""
    text, begins = induced_sort.join(pieces)
    found: list[list[int]] = [[] for _ in pieces]
    owner = np.repeat(np.arange(len(pieces)), [len(p) + 1 for p in pieces])
    previous, marked = -1, False

    def mark(at: int) -> None:
        found[owner[at]].append(int(at - begins[owner[at]]))

    for at, lcp in induced_sort.sorted_suffixes(text):
        if lcp >= least:
            if not marked:
                mark(previous)
            mark(at)
        marked, previous = lcp >= least, at
    return found


def symbols(core: int, before: bytes, after: bytes) -> np.ndarray:
    """A block as a string of numbers; the core is one of them."""
    out = np.empty(len(before) + 1 + len(after), np.int64)
    out[: len(before)] = np.frombuffer(before, np.uint8)
    out[len(before)] = 256 + core
    out[len(before) + 1 :] = np.frombuffer(after, np.uint8)
    return out


def _sorted_blocks(block: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        cores = size = 0
        last = None

        def done() -> pa.RecordBatch:
            found = repeated_starts([r[3] for r in rows], block)
            out: list[list] = [[] for _ in range(4)]
            for (anchor, whole, shift, _), starts in zip(rows, found):
                if starts:
                    at = np.sort(np.array(starts, np.int64)) + shift
                    cut = np.flatnonzero(np.diff(at) > 1)
                    for first, end in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]):
                        for column, value in zip(out, (anchor, whole, first, end)):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["anchor", "whole", "first", "last"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for anchor, whole, shift, core, before, after in zip(*columns):
                if core != last:
                    if size >= shard:
                        yield done()
                        rows, size, cores = [], 0, 0
                    cores, last = cores + 1, core
                piece = symbols(cores, before, after)
                rows.append((anchor, whole, shift, piece))
                size += len(piece) + 1
        if rows:
            yield done()

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = text.as_buffer().to_pybytes()
                kept, at, removed, n = [], 0, 0, 0
                if spans.is_valid:
                    pairs = np.array([(s["low"], s["high"]) for s in spans.as_py()], np.int64)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(pairs[:, 1]) + length
                    fresh = np.append(True, pairs[1:, 0] > reach[:-1])
                    begins = pairs[fresh, 0]
                    ends = reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(pairs) - 1)]
                    for a, b in zip(begins.tolist(), ends.tolist()):
                        kept.append(data[at:a])
                        at, removed, n = b, removed + b - a, n + 1
                kept.append(data[at:])
                for column, value in zip(out, (len(data), removed, n, b"".join(kept))):
                    column.append(value)
            digests = [hashlib.sha256(k).hexdigest() for k in out[3]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(digests, pa.string()), pa.array(out[3], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, text, and ``name``, a hash of both for joins."""
    rows = whole_text(docs, hashed=True)
    return rows.withColumn("name", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text_hash"))


def divided(blocks: DataFrame, shard: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ranges of equal blocks, and one of each different block: of cores to sort, and of cores with more than ``shard`` symbols."""
    place = ["anchor", "whole", "shift"]
    kind = ["core", "before", "after"]
    one = F.min(F.struct(*place, "n_starts")).alias("one")
    kinds = written(blocks.groupBy(*kind).agg(F.count("*").alias("n"), one), "kinds")
    equal = join_groups(blocks, kinds.where("n > 1").select(*kind, "n"), kind, "n").select(
        "anchor", "whole", F.col("shift").cast("long").alias("first"), (F.col("shift") + F.col("n_starts") - 1).cast("long").alias("last")
    )
    size = F.sum(2 + F.octet_length("before") + F.octet_length("after")).alias("size")
    cores = written(kinds.groupBy("core").agg(F.count("*").alias("kinds"), size).where("kinds > 1"), "cores")
    different = written(join_groups(kinds, cores, ["core"], "kinds").select("one.*", *kind, "size"), "different")
    return equal, different.where(F.col("size") <= shard), different.where(F.col("size") > shard)


def single_strings(blocks: DataFrame, block: int) -> DataFrame:
    """Ranges (of one start) of the strings that several of these blocks hold."""
    left = "octet_length(before) - start"
    strings = written(
        blocks.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n_starts") - 1))).selectExpr(
            "anchor", "whole", "CAST(shift + start AS BIGINT) AS first", "core", "substring(before, start + 1) AS head",
            f"substring(after, 1, {block - 1} - ({left})) AS tail",
        ),
        "strings",
    )
    key = ["core", "head", "tail"]
    often = strings.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return join_groups(strings, written(often, "often"), key, "n").select("anchor", "whole", "first", F.col("first").alias("last"))


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """name of a document, and low, high: ranges of starts of repeated strings."""
    rows = _named(docs)
    found = rows.select("name", "text", "text_hash").mapInArrow(
        _stretch_rows(length, gram),
        "doc_id long, text_hash long, anchor long, whole long, place long, low long, high long",
    )
    found = written(found.select(F.col("doc_id").alias("name"), "anchor", "whole", "place", "low", "high"), "stretches")
    groups = found.groupBy("anchor").agg(
        F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("mixed")
    ).where("n > 1")
    shared = written(join_groups(found, written(groups, "anchors"), ["anchor"], "n").drop("n"), "shared")
    equal = shared.where("not mixed").select("name", "low", "high")

    mixed = shared.where("mixed")
    one = F.min(F.struct("name", "place", "low", "high")).alias("one")
    stretch = ["anchor", "whole"]
    distinct = written(mixed.groupBy(*stretch).agg(F.count("*").alias("copies"), one), "distinct_stretches")
    wanted = distinct.groupBy(F.col("one.name").alias("name")).agg(
        F.collect_list(F.struct("anchor", "whole", "one.place", "one.low", "one.high")).alias("wanted")
    )
    blocks = written(
        rows.select("name", "text").join(wanted, "name").select("text", "wanted").mapInArrow(
            _block_rows(length, block),
            "anchor long, whole long, shift int, n_starts int, core binary, before binary, after binary",
        ),
        "blocks",
    )
    equal_blocks, few, many = divided(blocks, shard)
    # one task a partition, whatever their bytes: sorting costs far more than reading
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = few.repartition(tasks, "core").sortWithinPartitions("core").select("anchor", "whole", "shift", "core", "before", "after").mapInArrow(
        _sorted_blocks(block, shard), "anchor long, whole long, first long, last long"
    )
    ranges = written(equal_blocks.unionByName(sorted_).unionByName(single_strings(many, block)), "ranges")
    # at most one range for each start of a stretch
    ranges = ranges.groupBy(*stretch).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    named = distinct.join(ranges, stretch, "left").select(*stretch, "copies", "ranges")
    named = written(named.where("copies > 1 OR ranges IS NOT NULL"), "repeated_stretches")
    again = join_groups(mixed.drop("mixed"), named, stretch, "copies")
    several = again.where("copies > 1").select("name", "low", "high")
    single = again.where("copies = 1").select("name", "low", F.explode("ranges").alias("r")).select(
        "name", (F.col("low") + F.col("r.first")).alias("low"), (F.col("low") + F.col("r.last")).alias("high")
    )
    return equal.unionByName(several).unionByName(single)


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (remaining bytes) of every row."""
    spans = repeated(docs, length, gram, block, shard).groupBy("name").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    spans = written(spans, "spans")
    rows = _named(docs).join(spans, "name", "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(
        _cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
