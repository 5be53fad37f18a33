"""Random, hashed, balanced and stratified splits."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def hash32(*parts: Column) -> Column:
    """A whole number below 2^32 fixed by the parts, the same on every engine and retry."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def unit_hash(*parts: Column) -> Column:
    """The same as a number in [0, 1)."""
    return hash32(*parts) / F.lit(float(HASH_RANGE))


def _bounds(weights: Sequence[float]) -> list[float]:
    total = float(sum(weights))
    if total <= 0 or any(w < 0 for w in weights):
        raise ValueError("weights must be nonnegative with a positive sum")
    return [b / total for b in accumulate(weights)][:-1]


def split_side(u: Column, weights: Sequence[float]) -> Column:
    """Index of the side a unit number falls on."""
    side = F.lit(0)
    for bound in _bounds(weights):
        side = side + (u >= bound).cast("int")
    return side


def with_hash_side(
    df: DataFrame, id_col: str, weights: Sequence[float], seed: int, *strata: str
) -> DataFrame:
    """Add ``side``; a narrow expression, so any number of sides costs one scan."""
    key = [F.col(id_col), F.lit(seed), *[F.col(s) for s in strata]]
    return df.withColumn("side", split_side(unit_hash(*key), weights))


def hash_split(
    df: DataFrame, id_col: str, weights: Sequence[float], seed: int
) -> list[DataFrame]:
    """Weighted random split that depends on the row id only."""
    sided = with_hash_side(df, id_col, weights, seed)
    return [sided.where(F.col("side") == i).drop("side") for i in range(len(weights))]


def random_split(df: DataFrame, weights: Sequence[float], seed: int | None = None) -> list[DataFrame]:
    """Spark's own weighted split, which depends on the row order."""
    return df.randomSplit([float(w) for w in weights], seed)


def stratified_split(
    df: DataFrame,
    id_col: str,
    label: str,
    weights: Sequence[float],
    seed: int,
    labels: Sequence | None = None,
) -> list[DataFrame]:
    """The same weighted split inside every class; ``labels`` limits the classes."""
    rows = df if labels is None else df.where(F.col(label).isin(list(labels)))
    sided = with_hash_side(rows, id_col, weights, seed, label)
    return [sided.where(F.col("side") == i).drop("side") for i in range(len(weights))]


def with_strata_side(
    df: DataFrame, id_col: str, label: str, fractions: dict, seed: int
) -> DataFrame:
    """``side`` 0 for the sampled share of each class, 1 for the rest.

    Classes without a fraction are not sampled.  Both sides come from one
    narrow expression, so they never overlap, whatever is recomputed.
    """
    share = F.lit(0.0)
    for value, fraction in fractions.items():
        share = F.when(F.col(label) == value, float(fraction)).otherwise(share)
    u = unit_hash(F.col(id_col), F.lit(seed), F.col(label))
    return df.withColumn("side", F.when(u < share, 0).otherwise(1))


def window_offset(min_class: int, n_sup: int, seed: int, trial: int) -> int:
    """Start of the labelled window: uniform over the room left, 0 when there is none."""
    room = min_class - n_sup
    if room <= 0:
        return 0
    digest = hashlib.md5(f"{seed}:{n_sup}:{trial}".encode()).hexdigest()
    return int((room + 1) * (int(digest[:8], 16) / HASH_RANGE))


def in_window(ind: Column | str, start: int, n_sup: int) -> Column:
    column = F.col(ind) if isinstance(ind, str) else ind
    return (column >= start) & (column < start + n_sup)


def outside_window(ind: Column | str, start: int, n_sup: int) -> Column:
    column = F.col(ind) if isinstance(ind, str) else ind
    return (column < start) | (column >= start + n_sup)


def hide_labels(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*(columns or ("label", "weight")))


def balanced_split(
    df: DataFrame, start: int, n_sup: int, ind: str = "ind"
) -> tuple[DataFrame, DataFrame]:
    """``n_sup`` labelled rows of every class and the rest without labels."""
    labelled = df.where(in_window(ind, start, n_sup))
    unlabelled = hide_labels(df.where(outside_window(ind, start, n_sup)))
    return labelled, unlabelled


def size_sweep(df: DataFrame, id_col: str, sizes: Sequence[int], base: float, seed: int) -> DataFrame:
    """Rows of every labelled set of the sweep, keyed by ``n_sup``.

    A row joins size n when its unit number is below ``n / base``; the sets are
    nested and one scan yields all of them.
    """
    u = unit_hash(F.col(id_col), F.lit(seed))
    wanted = F.array(*[F.lit(int(s)) for s in sizes])
    return df.withColumn("_u", u).select(
        *df.columns,
        F.explode(F.filter(wanted, lambda n: F.col("_u") < n / F.lit(float(base)))).alias("n_sup"),
    )
