"""Packing of tokenized documents into sequences of at most ``CAPACITY`` tokens.

A document is its ids and an end id.  Longer documents are cut so that all
pieces but the first are full; full pieces are sequences of their own.  The rest
is dealt into shards of about SHARD_PIECES by hash.  In each shard a best-fit
pass gives first bins, then a local search empties the least filled one: it moves
documents to other underfull bins, exchanges one for one or two for one, and takes
only steps that increase the sum of squared fills, until the number of bins
reaches the bound of the shard's total or no step is left.

A shard wastes less than one bin against its bound in the usual case; the number
of shards follows the number of pieces.  A shard holds lengths only, never ids.

Defined cases: a null or empty text is the end id alone.  Null and repeated ids
are packed like any others.  An empty table gives no pieces.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm.bpe import Encoder
from labelspring.llm.common import releasing, whole_text, written

CAPACITY = 1024
END_ID = 2
SHARD_PIECES = 20_000
TOKENIZER = "byte_bpe_50k.json"


def _pieces(capacity: int, end_id: int, tokenizer: str):
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer)
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encoder.encode(text.as_py()) + end
                at = 0
                cut = len(data) % width or min(width, len(data))
                k = 0
                while at < len(data):
                    part = data[at:cut]
                    ids.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    at, cut, k = cut, cut + width, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32())] + [pa.array(c, pa.int64()) for c in (start, length, crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    return whole_text(docs).mapInArrow(
        releasing(_pieces(capacity, end_id, tokenizer), "bpe"), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


class Bins:
    """Bins of item numbers, found by their free space."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the bin that it leaves least free space in."""
        by_free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for item in sorted(range(len(self.lengths)), key=self.lengths.__getitem__, reverse=True):
            size = self.lengths[item]
            above = mask >> size
            if above:
                space = size + (above & -above).bit_length() - 1
                b = by_free[space].pop()
                if not by_free[space]:
                    mask &= ~(1 << space)
                self.items[b].append(item)
                left = space - size
            else:
                b, left = len(self.items), self.capacity - size
                self.items.append([item])
                self.free.append(left)
            self.free[b] = left
            if left:
                by_free[left].append(b)
                mask |= 1 << left

    def _change(self, source: int, target: int, out: list[int], back: list[int]) -> None:
        moved = sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in back)
        for i in out:
            self.items[source].remove(i)
        for i in back:
            self.items[target].remove(i)
        self.items[source] += back
        self.items[target] += out
        self.free[source] += moved
        self.free[target] -= moved

    def _step(self, source: int, others: list[int]) -> bool:
        """The first exchange found that moves length from ``source`` into a fuller bin."""
        size = self.lengths
        mine = sorted(self.items[source], key=size.__getitem__, reverse=True)
        for target in others:
            room = self.free[target]
            if room == 0 or room > self.free[source]:
                continue  # moving towards the fuller of two bins increases the sum of squares
            for x in mine:
                if size[x] <= room:
                    self._change(source, target, [x], [])
                    return True
            theirs = sorted(self.items[target], key=size.__getitem__)
            best = None
            for x in mine:
                for y in theirs:
                    gain = size[x] - size[y]
                    if 0 < gain <= room and (best is None or gain > best[0]):
                        best = gain, [x], [y]
            for a in range(len(mine)):
                for b in range(a + 1, len(mine)):
                    pair = size[mine[a]] + size[mine[b]]
                    for y in theirs:
                        gain = pair - size[y]
                        if 0 < gain <= room and (best is None or gain > best[0]):
                            best = gain, [mine[a], mine[b]], [y]
            for a in range(len(theirs)):
                for b in range(a + 1, len(theirs)):
                    pair = size[theirs[a]] + size[theirs[b]]
                    for x in mine:
                        gain = size[x] - pair
                        if 0 < gain <= room and (best is None or gain > best[0]):
                            best = gain, [x], [theirs[a], theirs[b]]
            if best:
                self._change(source, target, best[1], best[2])
                return True
        return False

    def search(self) -> None:
        """Empty the least filled bins one after the other."""
        bound = -(-sum(self.lengths) // self.capacity)
        used = len(self.items)
        stuck: set[int] = set()
        while used > bound:
            under = [b for b, items in enumerate(self.items) if items and self.free[b]]
            sources = [b for b in under if b not in stuck]
            if not sources:
                break
            source = max(sources, key=self.free.__getitem__)
            others = sorted((b for b in under if b != source), key=lambda b: (-self.free[b], b))
            while self.items[source] and self._step(source, others):
                pass
            if self.items[source]:
                stuck.add(source)
            else:
                used -= 1
                stuck.clear()
        keep = [items for items in self.items if items]
        self.items = keep


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.search()
    return bins.items


def _pack_shard(capacity: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        sequence = np.zeros(len(rows), np.int64)
        offset = np.zeros(len(rows), np.int64)
        lengths = rows["length"].tolist()
        for n, items in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in items:
                sequence[i], offset[i] = n, at
                at += lengths[i]
        out = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        # even numbers are shards' sequences, odd ones full pieces
        out["sequence_id"] = 2 * ((int(key[0]) << 32) + sequence)
        out["offset"] = offset
        return out

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = written(
        pieces(docs, capacity, end_id, tokenizer).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    full = rows.where(F.col("length") == capacity)
    open_ = rows.where(F.col("length") < capacity)
    shards = max(1, math.ceil(open_.count() / SHARD_PIECES))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ends = open_.select(*names, "row", shard).groupBy("shard").applyInPandas(_pack_shard(capacity), kind)
    return full.select(*names, (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(ends)
