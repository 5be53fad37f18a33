"""Benchmark decontamination by a prefix-filtered set join, DataFrame functions only.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words is one
window.  Windows and documents are sets of shingles of up to ``SHINGLE`` words.

1. One scan of the documents keeps the places (row, position) of shingles that
   occur in the benchmark at all, plus one row per document with its word count.
2. Shingles are ordered by how often they occur in the documents.  Containment of
   a whole window needs every shingle, so the rarest one is a sufficient prefix.
3. Places of prefix shingles give candidate window starts; a window must begin at
   or after the first word and end at or before the last.
4. A candidate is verified exactly: each shingle of the window at its own place.

The shingles of the benchmark are broadcast only up to BROADCAST_SHINGLES rows of
8 bytes, which is counted first; beyond that the scan is a shuffle join with the
same result.  Later steps see only places of benchmark shingles.

Defined cases: null text or no words gives no windows, n_words 0 and no hits.
Items with null id are ignored; equal windows of several items count for each.
Repeated rows and null ids each give a row of their own.  An empty benchmark hits
nothing, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.llm.common import ascii_lower, whole_text, without, written

WINDOW = 10
SHINGLE = 3
BROADCAST_SHINGLES = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def shingle(array: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from position ``at``; null where the words end before."""
    parts = [F.get(array, at + i) for i in range(size)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(size), *parts))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, window (a hash of its words), length, and its shingles: place in the window and value."""
    items = benchmark.where("item_id is not null").select("item_id", words(F.coalesce("text", F.lit(""))).alias("w"))
    length = F.least(F.lit(window), F.size("w"))
    starts = items.where(F.size("w") > 0).select(
        "item_id", "w", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("w") - length)).alias("start")
    )
    text = F.slice("w", F.col("start") + 1, F.col("length"))
    return starts.select("item_id", text.alias("words"), "length").withColumn(
        "window", F.xxhash64(F.concat_ws(" ", "words"))
    )


def window_shingles(found: DataFrame) -> DataFrame:
    """window, length, place, shingle of every distinct window."""
    once = found.dropDuplicates(["window"])
    size = F.least(F.lit(SHINGLE), F.col("length"))
    placed = once.select("window", "length", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("length") - size)).alias("place"))
    value = F.lit(None).cast("long")
    for n in range(1, SHINGLE + 1):
        value = F.when(F.col("size") == n, shingle(F.col("words"), F.col("place"), n)).otherwise(value)
    return placed.select("window", "length", "size", "place", value.alias("shingle"))


def places(docs: DataFrame, known: DataFrame, sizes: list[int]) -> DataFrame:
    """row, doc_id, n_words, position, shingle: places of known shingles, and one row at -1 for each document."""
    split = whole_text(docs, hashed=True).select(
        "doc_id", "text_hash", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w")
    )
    position = F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("position")
    cells = split.select("doc_id", "text_hash", "row", "w", F.size("w").cast("long").alias("n_words"), position)
    if len(sizes) == 1:
        value = shingle(F.col("w"), F.col("position"), sizes[0])
        cells = cells.withColumn("shingle", F.when(F.col("position") >= 0, value))
    else:
        value = F.array(*(shingle(F.col("w"), F.col("position"), n) for n in sizes))
        first = F.array(F.lit(None).cast("long"))
        cells = cells.withColumn("shingle", F.explode(F.when(F.col("position") >= 0, value).otherwise(first)))
    cells = cells.drop("w").join(known, "shingle", "left").where("position < 0 or known")
    own = F.col("position") < 0
    return cells.select(
        "row", F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("text_hash")).alias("text_hash"),
        "n_words", "position", "shingle",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``."""
    found = written(windows(benchmark, window), "windows")
    parts = written(window_shingles(found), "window_shingles")
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect()) or [SHINGLE]  # at most SHINGLE rows
    known = written(parts.select("shingle", F.lit(True).alias("known")).distinct(), "known")
    if known.count() <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    kept = written(places(docs, known, sizes), "places")
    rows, hits = kept.where("position < 0"), kept.where("position >= 0").select("row", "n_words", "position", "shingle")

    counted = hits.groupBy("shingle").agg(F.count("*").alias("occurrences"))
    rarest = F.min(F.struct("occurrences", "place", "shingle")).alias("r")
    prefix = written(
        parts.join(counted, "shingle", "left").groupBy("window", "length")
        .agg(rarest, F.count("occurrences").alias("present"), F.max(F.col("length") - F.col("size") + 1).alias("needed"))
        .where("present = needed").select("window", "length", "needed", "r.place", "r.shingle"),
        "prefix",
    )
    start = (F.col("position") - F.col("place")).alias("start")
    candidates = hits.join(prefix, "shingle").select("row", "window", "length", "needed", "n_words", start)
    candidates = candidates.where("start >= 0 and start + length <= n_words")
    wanted = candidates.join(parts.select("window", "place", "shingle"), "window").select(
        "row", "window", "length", "needed", "start", (F.col("start") + F.col("place")).alias("position"), "shingle"
    )
    matched = written(
        wanted.join(hits.select("row", "position", "shingle"), ["row", "position", "shingle"])
        .groupBy("row", "window", "start", "length", "needed").count().where("count = needed")
        .select("row", "window", "start", "length"),
        "matched",
    )
    covered = matched.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("p"))
    n_hit = covered.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    ids = found.select("window", F.col("item_id").cast("string").alias("item_id")).distinct()
    items = (
        matched.select("row", "window").distinct().join(ids, "window").select("row", "item_id").distinct()
        .groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    )
    per_row = n_hit.join(items, "row")
    none = F.array().cast("array<string>")
    listed = F.coalesce("items", none)
    return rows.join(per_row, "row", "left").select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    found = contamination(docs, benchmark, window).where("contaminated")
    return without(docs, written(found.select("doc_id", "text_hash"), "contaminated"))
