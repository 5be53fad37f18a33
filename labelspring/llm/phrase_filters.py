"""Phrase mining with counting quotient filters over packed word ids.

1. Texts become word sequences once: a task codes the words of a shard (about SHARD_WORDS
   words) with a dictionary of its own and writes codes, words and counts.
2. Spark sums the word counts by language.  Only words found LEAST times can be part of a
   phrase found LEAST times; they get global ids (0 stands for every border and every rarer
   word), and each shard's codes are translated through a join with its own dictionary.
3. For n = 2, 3, 4 the ids of n words are packed into 32 n bits and permuted by an
   invertible Feistel network.  The left half is the quotient, the right half the full
   remainder, so a filter loses nothing: sorted by quotient, then remainder, with a
   counter each.  Filters of parts of a shard merge by sorted merging, those of all shards
   in a Spark aggregate on (quotient, remainder), whose keys are spread evenly.
4. A phrase of n words is counted only where both of its (n - 1)-word parts may be frequent,
   by a bitmap over the quotients of the frequent ones.  It has at most BITMAP bits at any
   size of the corpus, and no frequent phrase ever fails it: the counts stay exact.
5. Phrases are unpacked, cut, scored in decimals, compared with the longer phrases around
   them, ranked within their language, and spelled.

Defined cases: null text is empty; a null language is ``und``; empty texts have no words;
repeated rows count as often as they occur; ties are broken by score, count and spelling.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelspring.llm.common import written
from labelspring.llm.words import mix
from labelspring.operators.joins import join_groups
from labelspring.operators.ranking import rank_within

LEAST = 30  # occurrences of a phrase
LONGEST = 4  # words of a phrase
TOP = 2000  # phrases of a language
COVERED = 80  # a phrase goes if a longer one has this percentage of its occurrences
SCALE = 2_000_000

SHARD_WORDS = 1 << 20  # words of a shard; one longer text is a shard of its own
HELD_SHARDS = 2  # a task gives all its shards to Spark when they hold this many times as many words
SLICE = 1 << 20  # bytes that are split into words at once
CAPACITY = 3 << 18  # entries of a filter before it is given to Spark
BITMAP = 1 << 27  # most bits of a bitmap: 16 MB
SPARSE = 16  # bits for each frequent phrase, while the bitmap has room

# What ends a piece of text.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + PIECE_ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(PIECE_ENDS)
)
_BORDER = b"."  # holds a piece end, so it is never a word

_U = np.uint64
_ROUNDS = [(int(mix(np.array([2 * i + 1], _U))[0]) | 1, int(mix(np.array([2 * i + 2], _U))[0])) for i in range(4)]


# ---------------------------------------------------------------- words


class _Codes(dict):
    """Codes of the words of one shard, from 1 on in order of appearance; 0 is the border."""

    def __init__(self):
        super().__init__({_BORDER: 0})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _parts(text: bytes) -> Iterator[bytes]:
    """The prepared text in parts of about SLICE bytes, cut between words."""
    at = 0
    while len(text) - at > SLICE:
        end = max(text.rfind(b" ", at, at + SLICE), text.rfind(b"\n", at, at + SLICE))
        if end <= at:
            later = [e for e in (text.find(b" ", at + SLICE), text.find(b"\n", at + SLICE)) if e >= 0]
            if not later:
                break
            end = min(later)
        yield text[at:end]
        at = end
    yield text[at:]


def word_codes(text: bytes, codes: dict) -> Iterator[np.ndarray]:
    """Codes of the words of a text, 0 between its pieces."""
    for part in _parts(text.translate(_LOWER)):
        found = part.replace(b"\n", b" . ").split()
        yield np.fromiter(map(codes.__getitem__, found), np.uint32, len(found))


class _Shard:
    def __init__(self):
        self.codes, self.parts, self.words = _Codes(), [], 0

    def add(self, text: bytes) -> int:
        """Take in a text; the number of its words and borders."""
        parts = [*word_codes(text, self.codes), np.zeros(1, np.uint32)]
        self.parts += parts
        added = sum(map(len, parts))
        self.words += added
        return added

    def row(self) -> tuple:
        sequence = np.concatenate(self.parts)
        counts = np.bincount(sequence, minlength=len(self.codes))[1:]
        return [w for w in self.codes if w != _BORDER], counts, sequence.tobytes()


def _shards(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, _Shard] = {}
        total = 0

        def row(lang: str) -> pa.RecordBatch:
            nonlocal number, total
            shard = held.pop(lang)
            total -= shard.words
            found, counts, sequence = shard.row()
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()), pa.array([lang]),
                    pa.array([found], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([sequence], pa.binary()),
                ],
                names=["shard", "lang", "words", "counts", "codes"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = held.setdefault(lang, _Shard())
                total += shard.add(text.as_buffer().to_pybytes())
                if shard.words >= limit:
                    yield row(lang)
                if total >= HELD_SHARDS * limit:
                    yield from map(row, list(held))
        yield from map(row, list(held))

    return run


def shards_of(docs: DataFrame, limit: int = SHARD_WORDS) -> DataFrame:
    """shard, lang, words, counts, codes: the coded texts as a written table."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    return written(
        rows.mapInArrow(_shards(limit), "shard long, lang string, words array<string>, counts array<long>, codes binary"), "shards"
    )


def frequent_words(shards: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id of the words found ``least`` times; ids from 1 on, in order of (lang, word)."""
    each = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    counts = each.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    frequent = written(counts.where(F.col("f") >= least), "words")
    ranked = rank_within(frequent.withColumn("all", F.lit(0)), "all", [F.col("lang"), F.col("word")], "rank")
    ranked = written(ranked.select("lang", "word", "f", (F.col("rank") + 1).alias("id")), "word_ids")
    if ranked.where(F.col("id") >= 1 << 32).isEmpty():
        return ranked
    raise ValueError("more frequent words than 32 bits can number")


def _translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, size, known in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
            ids = np.zeros(size + 1, np.uint32)
            if known.is_valid and len(known.values):
                ids[known.values.field(0).to_numpy() + 1] = known.values.field(1).to_numpy().astype(np.uint32)
            sequence = ids[np.frombuffer(codes.as_buffer(), np.uint32)]
            yield pa.RecordBatch.from_arrays([pa.array([sequence.tobytes()], pa.binary())], names=["ids"])


def id_sequences(shards: DataFrame, words: DataFrame) -> DataFrame:
    """``ids`` (32-bit little-endian) of every shard, 0 for borders and rare words."""
    own = shards.select("shard", "lang", F.posexplode("words").alias("pos", "word"))
    known = own.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(
        F.collect_list(F.struct("pos", "id")).alias("known")  # at most the words of one shard
    )
    rows = shards.select("shard", "codes", F.size("words").alias("size")).join(known, "shard", "left")
    return written(rows.select("codes", "size", "known").mapInArrow(_translate, "ids binary"), "ids")


# ---------------------------------------------------------------- filters


def _half(n: int) -> tuple[_U, _U]:
    """Bits of half a key of ``n`` words, and their mask."""
    bits = 16 * n
    return _U(bits), _U((1 << bits) - 1)


def permuted(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Quotient and remainder (16 n bits each) of the packed ids of n = 2, 3 or 4 words."""
    n = len(columns)
    w = [c.astype(_U) for c in columns]
    if n == 2:
        left, right = w
    elif n == 3:
        left, right = (w[0] << _U(16)) | (w[1] >> _U(16)), ((w[1] & _U(0xFFFF)) << _U(32)) | w[2]
    else:
        left, right = (w[0] << _U(32)) | w[1], (w[2] << _U(32)) | w[3]
    mask = _half(n)[1]
    for a, b in _ROUNDS:
        left, right = right, left ^ (mix(right * _U(a) + _U(b)) & mask)
    return left, right


def restored(quotient: np.ndarray, remainder: np.ndarray, n: int) -> list[np.ndarray]:
    """The word ids of quotients and remainders: the inverse of ``permuted``."""
    left, right = quotient, remainder
    mask = _half(n)[1]
    for a, b in reversed(_ROUNDS):
        left, right = right ^ (mix(left * _U(a) + _U(b)) & mask), left
    low = _U(0xFFFFFFFF)
    if n == 2:
        return [left, right]
    if n == 3:
        return [left >> _U(16), ((left & _U(0xFFFF)) << _U(16)) | (right >> _U(32)), right & low]
    return [left >> _U(32), left & low, right >> _U(32), right & low]


class QuotientFilter:
    """Exact counters of n-word keys: runs of remainders under their quotients, both ascending.

    Counters take one byte; the few that need more are kept aside with their places.
    """

    def __init__(self, n: int):
        self.n = n
        self.quotient = self.remainder = np.zeros(0, _U)
        self.small, self.large_at, self.large = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.quotient)

    @property
    def counts(self) -> np.ndarray:
        out = self.small.astype(np.int64)
        out[self.large_at] = self.large
        return out

    def _set(self, quotient: np.ndarray, remainder: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        self.quotient, self.remainder = quotient, remainder
        self.large_at = np.flatnonzero(counts > 255)
        self.large = counts[self.large_at]
        self.small = np.minimum(counts, 255).astype(np.uint8)
        return self

    def _sorted_sums(self, quotient, remainder, counts) -> QuotientFilter:
        if not len(quotient):
            return self._set(quotient, remainder, np.zeros(0, np.int64))
        if self.n == 2:
            # both halves fit one number
            keys = (quotient << _U(32)) | remainder
            if counts is None:
                keys.sort()
            else:
                order = np.argsort(keys, kind="stable")
                keys, counts = keys[order], counts[order]
                del order
            same = keys[1:] == keys[:-1]
        else:
            order = np.lexsort((remainder, quotient))
            quotient, remainder = quotient[order], remainder[order]
            counts = None if counts is None else counts[order]
            same = (quotient[1:] == quotient[:-1]) & (remainder[1:] == remainder[:-1])
        at = np.flatnonzero(np.concatenate([[True], ~same]))
        sums = np.diff(np.append(at, len(same) + 1)) if counts is None else np.add.reduceat(counts, at)
        if self.n == 2:
            keys = keys[at]
            return self._set(keys >> _U(32), keys & _U(0xFFFFFFFF), sums)
        return self._set(quotient[at], remainder[at], sums)

    @classmethod
    def of(cls, quotient: np.ndarray, remainder: np.ndarray, n: int) -> QuotientFilter:
        """The filter of keys as they occur."""
        return cls(n)._sorted_sums(quotient, remainder, None)

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """The filter of both inputs' occurrences; two sorted runs are merged."""
        if not len(self):
            return other
        return QuotientFilter(self.n)._sorted_sums(
            np.concatenate([self.quotient, other.quotient]), np.concatenate([self.remainder, other.remainder]),
            np.concatenate([self.counts, other.counts]),
        )


def may_be_frequent(quotient: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    place = quotient & _U(64 * len(bitmap) - 1)
    return ((bitmap[place >> _U(6)] >> (place & _U(63))) & _U(1)).astype(bool)


def windows(ids: np.ndarray, n: int, bitmaps: dict[int, np.ndarray]) -> np.ndarray:
    """Places where n words without a border begin whose shorter parts may all be frequent."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    good = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
    for k in range(2, n):
        # both k-word parts of every window of k + 1 words
        if not len(good):
            break
        fits = may_be_frequent(permuted([ids[good + i] for i in range(k)])[0], bitmaps[k])
        flag = np.zeros(len(ids) + 1, bool)
        flag[good[fits]] = True
        good = np.flatnonzero(flag[:-1] & flag[1:])
    return good


def _filters(n: int, shared, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = {k: b.value for k, b in shared.items()}
        held = QuotientFilter(n)
        for batch in batches:
            for value in batch.column(0):
                ids = np.frombuffer(value.as_buffer(), np.uint32)
                at = windows(ids, n, bitmaps)
                for i in range(0, len(at), capacity):
                    part = at[i : i + capacity]
                    held = held.merge(QuotientFilter.of(*permuted([ids[part + j] for j in range(n)]), n))
                    if len(held) >= capacity:
                        yield from _filter_rows(held)
                        held = QuotientFilter(n)
        yield from _filter_rows(held)

    return run


def _filter_rows(held: QuotientFilter, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    counts = held.counts
    for i in range(0, len(held), step):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(held.quotient[i : i + step].view(np.int64)), pa.array(held.remainder[i : i + step].view(np.int64)),
                pa.array(counts[i : i + step]),
            ],
            names=["quotient", "remainder", "f"],
        )


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """The bits of the frequent quotients; at most BITMAP of them, whatever the corpus."""
    bits = 1 << 16
    wanted = SPARSE * frequent.count()
    while bits < min(wanted, BITMAP):
        bits *= 2
    place = F.col("quotient").bitwiseAND(F.lit(bits - 1))
    packed = frequent.select(place.alias("p")).selectExpr("shiftright(p, 6) AS word", "shiftleft(1L, CAST(p & 63 AS INT)) AS bit")
    table = packed.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, _U)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(_U)
    return out


def _unpacked(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, r = (batch.column(i).to_numpy().view(_U) for i in (0, 1))
            ids = [c.view(np.int64) for c in restored(q, r, n)]
            ids += [np.zeros(len(q), np.int64)] * (LONGEST - n)
            yield pa.RecordBatch.from_arrays([*map(pa.array, ids), batch.column(2)], names=[*_WORDS, "f"])

    return run


_WORDS = [f"w{i + 1}" for i in range(LONGEST)]


def frequent_phrases(sequences: DataFrame, least: int, capacity: int = CAPACITY) -> DataFrame:
    """w1 .. w4 (word ids, 0 behind the last), f: every phrase of 2 to 4 words found ``least`` times."""
    spark = sequences.sparkSession
    shared, out = {}, None
    for n in range(2, LONGEST + 1):
        counted = sequences.mapInArrow(_filters(n, shared, capacity), "quotient long, remainder long, f long")
        frequent = written(
            counted.groupBy("quotient", "remainder").agg(F.sum("f").alias("f")).where(F.col("f") >= least), f"phrases_{n}"
        )
        phrases = frequent.mapInArrow(_unpacked(n), ", ".join(f"{w} long" for w in _WORDS) + ", f long")
        out = phrases if out is None else out.unionByName(phrases)
        if n < LONGEST:
            shared = {**shared, n: spark.sparkContext.broadcast(_bitmap(frequent))}
    return written(out, "phrases")


# ---------------------------------------------------------------- scores


def _slice(first: int, end: int) -> list[str]:
    """Word columns of the part from word ``first`` to ``end`` (from 0), moved to the front."""
    own = _WORDS[first:end]
    return own + ["0L"] * (LONGEST - len(own))


def _struct(fields: list[str], **more: str) -> str:
    pairs = [f"'{w}', {f}" for w, f in zip(_WORDS, fields)] + [f"'{k}', {v}" for k, v in more.items()]
    return f"named_struct({', '.join(pairs)})"


def _parts_of(columns: str) -> str:
    """SQL: structs for the parts of each cut; ``columns`` counts the words."""
    cases = []
    for n in range(2, LONGEST + 1):
        rows = [
            _struct(_slice(*part), k=str(k), side=str(side))
            for k in range(1, n) for side, part in enumerate(((0, k), (k, n)))
        ]
        cases.append(f"WHEN {n} THEN array({', '.join(rows)})")
    return f"CASE {columns} {' '.join(cases)} END"


def _inner_of(columns: str) -> str:
    """SQL: structs for the shorter phrases of at least two words inside a phrase."""
    cases = []
    for n in range(3, LONGEST + 1):
        rows = [_struct(_slice(i, i + m)) for m in range(2, n) for i in range(n - m + 1)]
        cases.append(f"WHEN {n} THEN array({', '.join(rows)})")
    return f"CASE {columns} {' '.join(cases)} END"


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """w1 .. w4, a, l, r, score of every phrase, by its lowest-scoring cut."""
    single = words.selectExpr("id AS w1", "0L AS w2", "0L AS w3", "0L AS w4", "f AS part_f")
    known = written(single.unionByName(phrases.withColumnRenamed("f", "part_f").where("w4 = 0")), "part_counts")
    size = "CAST(2 + INT(w3 > 0) + INT(w4 > 0) AS INT)"
    owner = f"{_struct(_WORDS, a='f')} AS phrase"
    parts = written(
        phrases.selectExpr(owner, f"explode({_parts_of(size)}) AS p").selectExpr("phrase", "p.*"), "parts"
    )
    sums = join_groups(parts, known, _WORDS).groupBy("phrase", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("part_f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("part_f"))).alias("r")
    )
    exact = f"CAST({SCALE} AS DECIMAL(10,0)) * CAST(phrase.a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"
    cuts = sums.selectExpr("phrase", f"named_struct('score', {exact}, 'k', k, 'l', l, 'r', r) AS cut")
    best = cuts.groupBy("phrase").agg(F.min("cut").alias("cut"))
    return best.select("phrase.*", "cut.l", "cut.r", "cut.score")


def uncovered(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases that no longer one covers."""
    size = "CAST(2 + INT(w3 > 0) + INT(w4 > 0) AS INT)"
    inner = phrases.where("w3 > 0").selectExpr(f"explode({_inner_of(size)}) AS p", "f AS longer").selectExpr("p.*", "longer")
    most = inner.groupBy(*_WORDS).agg(F.max("longer").alias("longer"))
    joined = phrases.join(most, _WORDS, "left")
    return joined.where(f"longer IS NULL OR 100 * longer < {percent} * f").select(*_WORDS)


def phrases_by_score(
    docs: DataFrame, least: int = LEAST, percent: int = COVERED, top: int = TOP, shard: int = SHARD_WORDS, capacity: int = CAPACITY
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of every language."""
    shards = shards_of(docs, shard)
    totals = shards.select("lang", F.expr("aggregate(counts, 0L, (s, c) -> s + c)").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = frequent_words(shards, least)
    phrases = frequent_phrases(id_sequences(shards, words), least, capacity)
    left = written(scored(phrases, words).join(uncovered(phrases, percent), _WORDS), "scored")
    lang = words.select(F.col("id").alias("w1"), "lang")
    placed = join_groups(left, lang, ["w1"])
    order = [F.col("score").desc(), F.col("a").desc()]
    # every phrase that ties with the last place stays until it is spelled
    near = placed.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top)
    near = written(near.drop("place"), "near_top")
    spelling = words.select("id", "word")
    each = near.select("lang", *_WORDS, F.posexplode(F.array(*_WORDS)).alias("pos", "id")).where("id > 0")
    spelled = each.join(spelling, "id").groupBy(*_WORDS).agg(
        F.expr("array_join(transform(sort_array(collect_list(named_struct('pos', pos, 'word', word))), x -> x.word), ' ')").alias("phrase")
    )
    rows = near.join(spelled, _WORDS).join(totals, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    rows = rows.withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
