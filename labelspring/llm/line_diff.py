"""Line deduplication by pairwise alignment.

Documents overlap if they share lines.  A line's first holder is the smallest
document (by doc_id) that has it.  Every document is paired with the first holders of
all its lines that an earlier document holds too, so it has at most one partner for
each of its shared lines, however many documents share a line.  The anchors of a pair
are the lines through which it meets.  A pair is aligned by patience diff on line
hashes, and aligned blocks that hold one of the pair's anchors go from the later document.

Lines are compared without white space at their ends; blank lines are no anchors and
go only with an aligned block.  All decisions are made on the
input, so the first holder of a deleted block always keeps it.

Defined cases: a null or empty text is one blank line and keeps it.  Rows
repeated with one id and text are one document, each with the same result.  Null ids come first.  An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm.common import whole_text, written

SPLIT = 256  # documents that meet one copy of their common partner


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
        before[i] = ends[k - 1] if k else -1
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(later: list[int], earlier: list[int]) -> list[tuple[int, int]]:
    """Aligned (later, earlier) places: unique common lines in order, then the gaps between, then equal neighbours.

    Blank lines (0) are aligned as neighbours only.  A gap without unique common lines goes by
    the order of their occurrences.
    """
    pairs: list[tuple[int, int]] = []
    stack = [(0, len(later), 0, len(earlier))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and later[a] == earlier[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and later[b - 1] == earlier[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a >= b or c >= d:
            continue
        here, there = Counter(later[a:b]), Counter(earlier[c:d])
        place = {earlier[j]: j for j in range(c, d) if there[earlier[j]] == 1}
        common = [i for i in range(a, b) if later[i] and here[later[i]] == 1 and later[i] in place]
        meets = {i: place[later[i]] for i in common} or by_occurrence(later, earlier, a, b, c, d)
        common = list(meets)
        chain = [common[k] for k in longest_increasing(list(meets.values()))]
        left, low = a, c
        for i in chain:
            j = meets[i]
            pairs.append((i, j))
            stack.append((left, i, low, j))
            left, low = i + 1, j + 1
        if chain:
            stack.append((left, b, low, d))
    return sorted(pairs)


def by_occurrence(later: list[int], earlier: list[int], a: int, b: int, c: int, d: int) -> dict[int, int]:
    """In a gap without lines unique on both sides: the k-th of equal lines meets the k-th, blank ones aside."""
    places: dict[int, list[int]] = {}
    for j in range(d - 1, c - 1, -1):
        places.setdefault(earlier[j], []).append(j)
    return {i: places[later[i]].pop() for i in range(a, b) if later[i] and places.get(later[i])}


def aligned_blocks(later: list[int], earlier: list[int], anchors: set[int]) -> list[int]:
    """Places of the later document in aligned blocks with an anchor line."""
    out: list[int] = []
    block: list[int] = []
    held = False
    previous = None
    for pair in patience(later, earlier):
        if previous is None or pair != (previous[0] + 1, previous[1] + 1):
            out += block if held else []
            block, held = [], False
        block.append(pair[0])
        held = held or later[pair[0]] in anchors
        previous = pair
    return out + (block if held else [])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(i) for i in range(1, 4)))
        gone = [aligned_blocks(later.as_py(), earlier.as_py(), set(anchors.as_py())) for later, earlier, anchors in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["row", "gone"])


def lines_of(text):
    return F.split(text, "\n", -1)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a hash of both that names the document."""
    rows = whole_text(docs, hashed=True)
    return rows.select("doc_id", "text", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text_hash").alias("row"))


def line_hashes(docs: DataFrame) -> DataFrame:
    """row, doc_id, lines (hash of every line, 0 for blank ones)."""
    trimmed = lambda x: F.regexp_replace(x, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")
    value = lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))
    hashed = F.transform(lines_of(F.col("text")), lambda x: value(trimmed(x)))
    return keyed(docs).select("row", "doc_id", hashed.alias("lines"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """row, gone (places of deleted lines, sorted) of the documents that lose lines."""
    table = written(line_hashes(docs), "lines")
    holder = F.struct("doc_id", "row")
    held = table.select("row", "doc_id", F.explode(F.array_distinct("lines")).alias("line")).where("line <> 0")
    shared = written(
        held.groupBy("line").agg(F.count("*").alias("holders"), F.min(holder).alias("first")).where("holders > 1")
        .select("line", F.col("first.row").alias("first_row")),
        "shared",
    )
    open_ = held.join(shared, "line").where("row <> first_row")
    met = written(
        open_.groupBy("row", F.col("first_row").alias("partner")).agg(F.collect_set("line").alias("anchors")), "met"
    )
    # the holder of a frequent line is a partner of many: they are dealt over copies of it
    many = written(met.groupBy("partner").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT), "many")
    copies = F.ceil(F.coalesce("n", F.lit(1)) / SPLIT).cast("long")
    pairs = met.join(many, "partner", "left").select("row", "partner", "anchors", F.pmod(F.xxhash64("row"), copies).alias("copy"))
    pairs = written(pairs, "pairs")
    arrays = table.select("row", "lines").dropDuplicates(["row"])
    partners = pairs.select("partner", "copy").distinct().join(
        arrays.select(F.col("row").alias("partner"), F.col("lines").alias("earlier")), "partner"
    )
    both = pairs.join(arrays.withColumnRenamed("lines", "later"), "row").join(partners, ["partner", "copy"])
    gone = both.select("row", "later", "earlier", "anchors").mapInArrow(_align, "row long, gone array<int>")
    merged = gone.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    return written(merged.where("size(gone) > 0"), "gone")


def kept_text(text, gone):
    return F.concat_ws("\n", F.filter(lines_of(text), lambda _, i: ~F.array_contains(gone, i)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256, text (what stays) of every row."""
    rows = keyed(docs).join(removed_lines(docs), "row", "left")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("gone")))
    n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    out = rows.select(
        "doc_id", F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n_removed).cast("long").alias("n_removed"), text.alias("text"),
    )
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), "text")
