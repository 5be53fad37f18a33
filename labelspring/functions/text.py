"""Tokenizing and hashed term counts, all inside one row (no shuffle)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.functions import sql
from labelspring.functions.blocks import row_blocks
from labelspring.functions.stopwords import ENGLISH_STOP_WORDS

# Token pattern and shortest token kept.
TOKEN_PATTERN = r"[\W+_0-9]"
MIN_TOKEN_LENGTH = 2

HASH_FUNCTIONS = ("md5", "murmur3", "java")


def regex_tokens(
    text: str,
    pattern: str = TOKEN_PATTERN,
    min_length: int = MIN_TOKEN_LENGTH,
    lower: bool = True,
) -> str:
    """SQL: split on ``pattern`` and keep tokens of at least ``min_length``."""
    value = f"coalesce({text}, '')"
    if lower:
        value = f"lower({value})"
    return f"filter(split({value}, {sql.literal(pattern)}), t -> length(t) >= {int(min_length)})"


def space_tokens(text: str) -> str:
    """SQL: split on a single space; empty tokens stay."""
    return f"split({text}, ' ')"


def flat_tokens(nested: str) -> str:
    """SQL: tokens of a nested array in order, duplicates kept."""
    return f"flatten({nested})"


def without_stop_words(tokens: str, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> str:
    """SQL: drop stop words, comparing in lower case."""
    words = ", ".join(sql.literal(w.lower()) for w in stop_words)
    return f"filter({tokens}, t -> lower(t) NOT IN ({words}))"


def bucket_of(term: str, n_features: int, hash_fn: str = "md5") -> str:
    """SQL: feature index of one term.

    ``md5`` is portable to any SQL engine, ``murmur3`` is the cheapest, and
    ``java`` is the classic ``s[0]*31^(n-1) + ...`` string hash of UTF-16 units.
    """
    if hash_fn == "md5":
        h = f"CAST(conv(substring(md5({term}), 1, 8), 16, 10) AS BIGINT)"
    elif hash_fn == "murmur3":
        h = f"CAST(hash({term}) AS BIGINT)"
    elif hash_fn == "java":
        wrap = 1 << 32
        units = f"regexp_extract_all(hex(encode({term}, 'UTF-16BE')), '(.{{4}})', 1)"
        step = f"(acc * 31L + CAST(conv(unit, 16, 10) AS BIGINT)) % {wrap}L"
        unsigned = f"aggregate({units}, 0L, (acc, unit) -> {step})"
        h = sql.bind("u", unsigned, f"CASE WHEN u >= {wrap // 2}L THEN u - {wrap}L ELSE u END")
    else:
        raise ValueError(f"unknown hash function {hash_fn!r}; use one of {HASH_FUNCTIONS}")
    return f"CAST(pmod({h}, {int(n_features)}L) AS INT)"


def hashed_counts(tokens: str, n_features: int, hash_fn: str = "md5") -> str:
    """SQL: struct of ``buckets`` and ``counts`` (parallel arrays) and ``n_terms``.

    The buckets of all tokens are sorted inside the row; the first position of
    every run is a distinct bucket and the run length its count.
    """
    ordered = (
        f"sort_array(transform(coalesce({tokens}, CAST(array() AS ARRAY<STRING>)), "
        f"t -> {bucket_of('t', n_features, hash_fn)}))"
    )
    # sequence(0, -1) would count down, hence the guard for empty documents
    positions = "CASE WHEN size(o) > 0 THEN sequence(0, size(o) - 1) ELSE CAST(array() AS ARRAY<INT>) END"
    starts = f"filter({positions}, i -> i = 0 OR get(o, i) <> get(o, i - 1))"
    counted = (
        "named_struct('buckets', transform(f, s -> get(o, s)), "
        "'counts', transform(f, (s, i) -> coalesce(get(f, i + 1), size(o)) - s), "
        "'n_terms', size(o))"
    )
    return sql.bind("o", ordered, sql.bind("f", starts, counted))


def _md5_counts(n_features: int):
    """Arrow function with the result of ``hashed_counts``; hashes the distinct tokens of a batch once."""

    @F.arrow_udf("struct<buckets:array<int>,counts:array<int>,n_terms:int>")
    def count(tokens: pa.Array) -> pa.Array:
        sizes = tokens.value_lengths().to_numpy()
        coded = tokens.flatten().dictionary_encode()
        terms = coded.dictionary.cast(pa.binary()).to_pylist()
        # a null token sorts before all buckets
        bucket_of_code = np.array(
            [int.from_bytes(hashlib.md5(t).digest()[:4], "big") % n_features for t in terms] + [-1], dtype=np.int64
        )
        bucket = bucket_of_code[coded.indices.fill_null(len(terms)).to_numpy()]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        found, counts, n_found = [], [], np.zeros(len(sizes), dtype=np.int64)
        for first, stop in row_blocks(ends):
            owner = np.repeat(np.arange(stop - first), sizes[first:stop])
            key = np.sort(owner * (n_features + 1) + bucket[ends[first] : ends[stop]] + 1)
            row, place = np.divmod(key, n_features + 1)
            # as in SQL, where a comparison with a null starts no new run
            new = np.ones(len(key), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | ((place[1:] != place[:-1]) & (place[:-1] > 0))
            start = np.flatnonzero(new)
            found.append(place[start] - 1)
            counts.append(np.diff(np.append(start, len(key))))
            n_found[first:stop] = np.bincount(row[start], minlength=stop - first)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_found)]), pa.int32())
        found = np.concatenate([np.zeros(0, np.int64), *found])
        counts = np.concatenate([np.zeros(0, np.int64), *counts])
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32(), mask=found < 0)),
                pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                pa.array(sizes, pa.int32()),
            ],
            names=["buckets", "counts", "n_terms"],
        )

    return count


def with_hashed_counts(
    df: DataFrame,
    tokens: str,
    n_features: int,
    hash_fn: str = "md5",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """Add ``buckets``, ``counts`` (parallel int arrays, buckets ascending) and ``n_terms``.

    ``tokens`` is a column name or a SQL expression.  Nothing is exploded and
    nothing is shuffled, so the cost is that of the scan, and two primitive
    arrays keep cached and shuffled rows small.
    """
    if n_features < 1:
        raise ValueError("n_features must be positive")
    kept = [sql.name(c) for c in (keep if keep is not None else df.columns)]
    if hash_fn == "md5":
        words = F.expr(f"coalesce({tokens}, CAST(array() AS ARRAY<STRING>))")
        hashed = df.select(*[F.expr(c) for c in kept], _md5_counts(int(n_features))(words).alias("_hashed"))
    else:
        hashed = df.selectExpr(*kept, f"{hashed_counts(tokens, n_features, hash_fn)} AS _hashed")
    return hashed.selectExpr(*kept, "_hashed.buckets", "_hashed.counts", "_hashed.n_terms")


def explode_counts(df: DataFrame, *keep: str) -> DataFrame:
    """Long form ``(keep..., bucket, tf)`` of the parallel arrays.

    The outer variant keeps the planner from adding a size filter below, which
    would tokenize every document a second time.
    """
    kept = [sql.name(c) for c in keep]
    return (
        df.selectExpr(*kept, "counts", "posexplode_outer(buckets) AS (_pos, bucket)")
        .where("bucket IS NOT NULL")
        .selectExpr(*kept, "bucket", "CAST(get(counts, _pos) AS BIGINT) AS tf")
    )

