"""Near-duplicate detection with SetSketch registers.

1. Every document gets its set of word shingles and ``bands * ROWS`` SetSketch
   registers.  A register is the truncated logarithm (base ``BASE``) of the
   minimum of exponential variates over the set, so sketches of parts merge by
   maximum and equal registers are the more likely the more alike two sets are.
2. Equal sets are one class, represented by its smallest doc_id.  Copies of any
   number meet in a pre-aggregated count, never in a pair.
3. Representatives that share the registers of a band are candidates.  In each
   bucket only the most central member (whose buckets hold the most members) is
   paired with all others at first.  Members that this leaves in different
   components are paired in later rounds, so no link between different sets is
   lost and alike groups cost linear work.
4. Pairs that cannot be linked go by an exact bound: the parities of the set in
   ``PARITIES`` hash classes differ in no more classes than two sets differ in
   elements.  Then the joint likelihood of all registers of a pair estimates its
   similarity; pairs far below the threshold go, the rest is verified on the full sets.
5. Components come from min-label rounds over written tables.

The number of bands follows from the threshold, so that a pair at the threshold
misses all bands with a probability under MISS.  Nothing depends on the number
of documents, and nothing is collected to the driver.

Defined cases: null text is empty; documents without words have no shingles and
no links; fewer words than a shingle make one shingle.  Rows repeated with one id
are one class.  A null id is carried along and never represents others unless all
of its class are null.  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm import words
from labelspring.llm.common import releasing, whole_text, without, written

ROWS = 4  # registers in a band
MISS = 1e-6  # probability that a pair at the threshold shares no band
BASE = 1.001  # ratio of successive register values
RATE = 20.0  # rate of the exponential variates
TOP = (1 << 16) - 2  # registers are truncated to 0 .. TOP + 1
DEVIATIONS = 6  # estimates this far below the threshold are dropped before the check
PARITIES = 1024  # hash classes whose parity is kept, 64 in a long
BLOCK = 4096  # elements of a set whose variates are made at once
_U = np.uint64


def band_count(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1.0 - threshold**ROWS))


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * count + 1, dtype=_U)
    codes = words.mix(seeds * _U(0x9E3779B97F4A7C15))
    return (codes[:count] | _U(1))[:, None], codes[count:, None]


def sketch(elements: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of one set: 0 for the empty set."""
    if not len(elements):
        return np.zeros(len(a), np.int64)
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=_U)
    for i in range(0, len(elements), BLOCK):
        np.minimum(least, (a * elements[None, i : i + BLOCK] + b).min(axis=1), out=least)
    # the minimum of uniform variates gives the minimum of exponential ones
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1.0 - np.log(exponential) / math.log(BASE)), 0, TOP + 1).astype(np.int64)


def parities(elements: np.ndarray) -> np.ndarray:
    """The parity of the number of elements in each hash class, packed into longs."""
    classes = (words.mix(elements ^ _U(0x3C3C3C3C3C3C3C3C)) % _U(PARITIES)).astype(np.int64)
    odd = (np.bincount(classes, minlength=PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def may_link(left: str, right: str, n_left: str, n_right: str, percent: int):
    """False only for sets (parities and sizes in these columns) that differ in too many elements for a link.

    100 c >= percent (n + m - c) holds exactly if the symmetric difference n + m - 2 c is at
    most (100 - percent) / (100 + percent) of n + m; the differing classes are a lower bound of it.
    """
    differing = [F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(PARITIES // 64)]
    total = (F.col(n_left) + F.col(n_right)) * (100 - percent)
    return (100 + percent) * functools.reduce(operator.add, differing) <= total


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(left, right)


def jaccard_estimate(equal, above, below):
    """Likelihood estimate of the similarity from register comparisons (columns or numbers).

    With a base this close to 1 the registers of a pair are equal, larger or smaller with
    probabilities J, (1-J) u and (1-J) v, u + v = 1, so the joint likelihood
    J^equal (1-J)^(above+below) has its maximum at the share of equal registers.
    """
    return equal / (equal + above + below)


def _sketches(size: int, bands: int):
    a, b = multipliers(bands * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, end, data, offsets in words.slices(texts):
                hashes, at = words.word_hashes(data, offsets, words.WHITE_SPACE)
                n = end - first
                counts = np.zeros(n, np.int64)
                digests = np.zeros((n, 2), _U)
                registers = np.zeros((n, bands * ROWS), np.int32)
                odd = np.zeros((n, PARITIES // 64), np.int64)
                for i in range(n):
                    s = words.shingles(hashes[at[i] : at[i + 1]], size)
                    if len(s):
                        counts[i] = len(s)
                        digests[i] = s.sum(), words.mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum()
                        registers[i] = sketch(s, a, b)
                        odd[i] = parities(s)
                flat = pa.array(registers.ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, n),
                        batch.column(2).slice(first, n),
                        pa.array(counts),
                        pa.array(digests[:, 0].view(np.int64)),
                        pa.array(digests[:, 1].view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (bands * ROWS), flat),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (PARITIES // 64), pa.array(odd.ravel())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "registers", "odd"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for first, end, data, offsets in words.slices(texts):
                hashes, at = words.word_hashes(data, offsets, words.WHITE_SPACE)
                parts = [words.shingles(hashes[at[i] : at[i + 1]], size) for i in range(end - first)]
                ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
                values = pa.array(np.concatenate(parts).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "elements"]
                )

    return run


def sketch_documents(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    bands = band_count(threshold)
    return whole_text(docs, hashed=True).mapInArrow(
        releasing(_sketches(size, bands)),
        "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, registers array<int>, odd array<long>",
    )


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    return whole_text(docs).mapInArrow(releasing(_sets(size)), "doc_id long, elements array<long>")


def connected_components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v); component is the smallest reachable node.

    Each round gives a node the smallest label next to it and then the label of its label.
    """
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}_edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component")), f"{name}_0")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["node"] == near["u"]).select("node", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("of_low"))
        new = written(
            lower.join(jump, "low").select("node", F.least("low", "of_low").alias("next"), "component"), f"{name}_next"
        )
        changed = not new.where("next <> component").isEmpty()
        labels = new.select("node", F.col("next").alias("component"))
        if not changed:
            return labels


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links among candidate ``pairs`` (u, v): sizes, then the likelihood estimate, then the full sets."""
    threshold = percent / 100
    slack = DEVIATIONS * math.sqrt(threshold * (1 - threshold) / (band_count(threshold) * ROWS))
    one = lambda c: sketches.select(
        F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}"), F.col("odd").alias(f"o_{c}")
    )
    sized = pairs.join(one("u"), "u").join(one("v"), "v")
    sized = sized.where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
    sized = sized.where(may_link("o_u", "o_v", "n_u", "n_v", percent))
    both = F.arrays_zip(F.col("r_u").alias("l"), F.col("r_v").alias("r"))
    equal = F.size(F.filter(both, lambda x: x["l"] == x["r"]))
    above = F.size(F.filter(both, lambda x: x["l"] > x["r"]))
    below = F.size(both) - equal - above
    likely = written(sized.where(jaccard_estimate(equal, above, below) >= threshold - slack).select("u", "v", "n_u", "n_v"), "likely")
    wanted = written(likely.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "wanted")
    texts = whole_text(docs).join(wanted, "doc_id", "left_semi")
    sets = written(shingle_sets(texts, size), "sets")
    left = sets.select(F.col("doc_id").alias("u"), F.col("elements").alias("left"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("elements").alias("right"))
    common = F.size(F.array_intersect("left", "right")).cast("long")
    return (
        likely.join(left, "u").join(right, "v")
        .select("u", "v", "n_u", "n_v", common.alias("c"))
        .where(100 * F.col("c") >= percent * (F.col("n_u") + F.col("n_v") - F.col("c")))
        .select("u", "v")
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, hubs: int = 2048) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept, n_copies (documents with the same set) of every document.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets.
    ``hubs`` is the number of members that a mixed bucket pairs with its others in the second
    round; it grows fourfold with each round, so it orders the work and drops nothing.
    """
    sketches = written(sketch_documents(docs, size, percent / 100), "sketches")
    key = ["set_a", "set_b", "n_shingles"]
    classes = written(
        sketches.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")),
        "classes",
    )
    chosen = classes.where("rep is not null").select(*key, F.col("rep").alias("doc_id"))
    reps = written(
        sketches.join(chosen, [*key, "doc_id"], "left_semi").select("doc_id", "n_shingles", "registers", "odd"), "reps"
    )
    bands = band_count(percent / 100)
    keys = F.array(*(
        F.xxhash64(F.lit(b), *(F.element_at("registers", b * ROWS + r + 1) for r in range(ROWS))) for b in range(bands)
    ))
    member = reps.select("doc_id", F.explode(keys).alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    member = written(member.join(sizes, "bucket"), "members")
    score = member.groupBy("doc_id").agg(F.sum("members").alias("score"))
    central = F.max(F.struct(F.col("score"), (-F.col("doc_id")).alias("last")))
    hub = member.join(score, "doc_id").groupBy("bucket").agg((-central["last"]).alias("hub"))
    buckets = written(member.join(hub, "bucket").where("doc_id <> hub").select("bucket", "doc_id", "hub"), "buckets")
    pair = (F.least("hub", "doc_id").alias("u"), F.greatest("hub", "doc_id").alias("v"))
    tested = written(buckets.select(*pair).distinct(), "pairs")
    edges = written(_verified(tested, reps, docs, size, percent), "edges")
    labels = connected_components(edges)
    members = _mixed(buckets.select("bucket", "doc_id"), labels)
    members = members.join(reps.select("doc_id", "n_shingles", "odd"), "doc_id")
    while not members.isEmpty():
        pairs, members = _more_pairs(members, hubs, percent)
        new = written(pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        tested, hubs = tested.unionByName(new), 4 * hubs
        more = written(_verified(new, reps, docs, size, percent), "edges")
        if not more.isEmpty():
            edges = edges.unionByName(more)
            labels = connected_components(edges)
        members = _mixed(members, labels)
    return _of_documents(sketches, classes, labels, key)


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component, with component and bucket size."""
    columns = [c for c in members.columns if c not in ("component", "first", "members")]
    named = members.select(columns).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = named.withColumn("component", F.coalesce("component", "doc_id"))
    mixed = named.groupBy("bucket").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.min("doc_id").alias("first"), F.count("*").alias("members"),
    )
    return written(named.join(mixed.where("low <> high").drop("low", "high"), "bucket"), "mixed")


def _more_pairs(members: DataFrame, hubs: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of this round between members of different components, and the members left for later rounds.

    The smallest member of a bucket and about ``hubs`` others, chosen by hash, meet all members
    that their sizes and parities allow.  A bucket of up to ``hubs`` members is finished at once.
    """
    is_hub = (F.col("doc_id") == F.col("first")) | (
        F.pmod(F.xxhash64("doc_id", "bucket"), F.ceil(F.col("members") / hubs).cast("long")) == 0
    )
    marked = members.withColumn("is_hub", is_hub)
    hub = marked.where("is_hub").select(
        F.col("bucket").alias("b"), F.col("doc_id").alias("h"), F.col("component").alias("of_h"),
        F.col("n_shingles").alias("n_h"), F.col("odd").alias("odd_h"),
    )
    possible = (
        (F.col("bucket") == F.col("b")) & (F.col("component") != F.col("of_h"))
        & (100 * F.least("n_shingles", "n_h") >= percent * F.greatest("n_shingles", "n_h"))
        & may_link("odd", "odd_h", "n_shingles", "n_h", percent)
    )
    pairs = marked.join(hub, possible).select(F.least("doc_id", "h").alias("u"), F.greatest("doc_id", "h").alias("v"))
    return pairs.distinct(), marked.where("not is_hub").drop("is_hub")


def _of_documents(sketches: DataFrame, classes: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select(
        *key, "n_copies", F.coalesce("component", "rep").alias("component")
    )
    named = written(named, "named_classes")
    rows = sketches.select("doc_id", "text_hash", *key)
    full = rows.where("n_shingles > 0").join(named, key).select(
        "doc_id", "text_hash", "n_shingles", F.col("component").alias("component_id"), "n_copies"
    )
    empty = rows.where("n_shingles = 0").select(
        "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies")
    )
    return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns."""
    rows = written(near_duplicates(docs, size, percent).select("doc_id", "text_hash", "kept"), "decisions")
    gone = written(rows.where(~F.col("kept")).select("doc_id", "text_hash"), "gone")
    twice = rows.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1")
    return without(docs, gone, written(twice.select("doc_id", "text_hash"), "again"))
