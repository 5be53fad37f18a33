"""Length-normalised Naive Bayes as grouped aggregates.

Input rows carry ``buckets`` and ``counts`` (parallel arrays), ``n_terms`` and a
``label`` of any type.  A fitted model is a pair of small tables keyed by the
real label, so a class missing from the sample never shifts the others:

* prior(run, label, n, mass, seen, pi, log_denom)
* theta(run, label, bucket, mass, df, log_theta), seen cells only

Cells never seen share one value per class, ``ln(smoothing) - log_denom``, which
keeps the model as sparse as the data and the feature count a free parameter.
``run`` tells models apart that are fitted in the same job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.functions import sql
from labelspring.functions.blocks import rejected, row_blocks, row_values
from labelspring.functions.vectors import length_multiplier, length_of, violation
from labelspring.runtime import durable

MODEL_TYPES = ("multinomial", "bernoulli")

# Negative buckets stand for the document row itself, so that class sizes and
# hit counts come out of the same pass as the feature sums.
ROW = -1
_NO_BUCKET = -(1 << 31)

HELD_CELLS = 1 << 20  # cells whose sums a task holds at once, 32 bytes each


@dataclass(frozen=True)
class Params:
    n_features: int
    smoothing: float = 1.0
    model_type: str = "multinomial"
    normalise: bool = True
    label: str = "label"
    buckets: str = "buckets"
    counts: str = "counts"
    validate: bool = True
    # largest dense model, in cells of 8 bytes, that may be sent to the executors
    inline_cells: int = 8_000_000

    def __post_init__(self):
        if self.n_features < 1:
            raise ValueError("n_features must be positive")
        if not self.smoothing > 0:
            raise ValueError("smoothing must be positive")
        if self.model_type not in MODEL_TYPES:
            raise ValueError(f"unknown model type {self.model_type!r}; use one of {MODEL_TYPES}")


def class_cells(rows: DataFrame, params: Params) -> DataFrame:
    """Per (run, label, bucket): weight, summed normalised value, rows holding the bucket.

    ``rows`` may carry ``run``, ``row_weight``, ``counted`` (whether the row counts
    towards ``df``), ``row_bucket`` (which negative bucket stands for the row),
    ``row_length`` (the sum of the counts, where it is known already) and ``row_raw`` (true
    for rows whose values are not normalised, whatever the parameters say).
    A row that stands in many runs or classes carries ``roles`` instead, an array of ROLE structs, so
    that its features go to Python once whatever their number.
    Every task sums its rows by itself, without making a row of every term, which bounds the
    shuffle by classes x features per task, however unequal the classes are.
    """
    counts, buckets = sql.name(params.counts), sql.name(params.buckets)

    def optional(column: str, otherwise: str) -> str:
        return column if column in rows.columns else otherwise

    if "roles" in rows.columns:
        roles = "roles"
        kind = rows.schema["roles"].dataType.elementType["label"].dataType.simpleString()
    else:
        # a row without features keeps a cell of its own, outside all buckets
        own = f"IF({buckets} IS NULL, NULL, {optional('row_bucket', str(ROW))})"
        roles = f"array({role(optional('run', '0'), sql.name(params.label), optional('row_weight', '1'), optional('counted', '1'), own)})"
        kind = rows.schema[params.label].dataType.simpleString()
    length = optional("row_length", length_of(counts))
    prepared = rows.selectExpr(
        f"{roles} AS _roles",
        f"coalesce({buckets}, CAST(array() AS ARRAY<INT>)) AS _buckets",
        f"coalesce({counts}, array()) AS _counts",
        f"{length_multiplier(f'CASE WHEN {optional('row_raw', 'false')} THEN 0 ELSE {length} END') if params.normalise else '1D'} AS _factor",
    )
    partial = prepared.mapInArrow(
        _partial_cells(params.model_type, params.validate),
        f"run int, label {kind}, bucket int, weight double, mass double, df bigint",
    )
    return partial.groupBy("run", "label", "bucket").agg(
        F.sum("weight").alias("weight"), F.sum("mass").alias("mass"), F.sum("df").alias("df")
    )


def role(run: str, label: str, weight: str, counted: str, row_bucket: str, featured: str = "true") -> str:
    """SQL: ROLE struct, the part a row plays in one run and class; ``featured``: its features count."""
    return (
        f"named_struct('run', CAST({run} AS INT), 'label', {label}, 'weight', CAST({weight} AS DOUBLE),"
        f" 'counted', CAST({counted} AS INT), 'row_bucket', CAST({row_bucket} AS INT), 'featured', {featured})"
    )


def _partial_cells(model_type: str, validate: bool):
    """Arrow function: sums of each (run, label, bucket) of the rows of a task.

    Sums are held for at most HELD_CELLS cells, and handed on whenever others are needed; a block
    of rows that has more of them by itself is summed by sorting.  Spark adds up what comes out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["run", "label", "bucket", "weight", "mass", "df"]
        held: dict[tuple, np.ndarray] = {}
        kind = None

        def cells(keys: list[tuple], group: np.ndarray, bucket: pa.Array, sums: Sequence[np.ndarray]) -> pa.RecordBatch:
            weight, mass, df = sums
            runs = np.array([k[0] for k in keys], dtype=np.int32)[group]
            labels = pa.array([k[1] for k in keys], kind).take(pa.array(group))
            return pa.RecordBatch.from_arrays(
                [pa.array(runs), labels, bucket, pa.array(weight, pa.float64()), pa.array(mass, pa.float64()), pa.array(df.astype(np.int64))],
                names=names,
            )

        def release() -> Iterator[pa.RecordBatch]:
            for key, sums in held.items():
                seen = np.flatnonzero(sums[3])
                if len(seen):
                    yield cells([key], np.zeros(len(seen), np.int64), pa.array(seen, pa.int32()), sums[:3, seen])
            held.clear()

        for batch in batches:
            n_roles = batch.column(0).value_lengths().fill_null(0).to_numpy()
            roles = batch.column(0).flatten()
            if not len(roles):
                continue
            run_of, label, weight, counted, row_bucket, featured = roles.flatten()
            kind = label.type
            coded = label.dictionary_encode(null_encoding="encode")
            label_of = coded.dictionary.to_pylist()
            numbers, group = np.unique(
                run_of.to_numpy() * np.int64(len(label_of)) + coded.indices.to_numpy(), return_inverse=True
            )
            keys = [(int(k) // len(label_of), label_of[int(k) % len(label_of)]) for k in numbers]
            w, counted = weight.fill_null(0).to_numpy(), counted.fill_null(0).to_numpy()
            featured = featured.fill_null(True).to_numpy(zero_copy_only=False)

            # the rows themselves
            code = row_bucket.fill_null(_NO_BUCKET).to_numpy().astype(np.int64)
            found, at = np.unique((group.astype(np.int64) << 32) + (code - _NO_BUCKET), return_inverse=True)
            size = len(found)
            code = (found & 0xFFFFFFFF) + _NO_BUCKET
            yield cells(
                keys, found >> 32, pa.array(code, pa.int32(), mask=code == _NO_BUCKET),
                (np.bincount(at, w, size), np.zeros(size), np.bincount(at, counted, size)),
            )

            # their features
            lengths = batch.column(1).value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(lengths)])
            bucket = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            values = row_values(batch.column(1), batch.column(2))
            factor = batch.column(3).fill_null(0).to_numpy()
            first_role = np.cumsum(n_roles) - n_roles
            if validate:
                owner = np.repeat(np.arange(len(n_roles)), n_roles)
                taken = np.bincount(owner[featured], minlength=len(n_roles)) > 0
                bad = np.flatnonzero(rejected(values, model_type) & np.repeat(taken, lengths))
                if len(bad):
                    allowed = "0 or 1" if model_type == "bernoulli" else "nonnegative"
                    raise ValueError(f"{model_type} features must be {allowed}, found {values[bad[0]]}")
            for first, stop in row_blocks(ends):
                lo, hi = ends[first], ends[stop]
                if lo == hi:
                    continue
                n = lengths[first:stop]
                span = int(bucket[lo:hi].max()) + 1
                scaled = values[lo:hi] * np.repeat(factor[first:stop], n)
                for place in range(int(n_roles[first:stop].max())):
                    # the role at this place of every row that has one: no row comes twice
                    has = n_roles[first:stop] > place
                    mine = first_role[first:stop][has] + place
                    has[has] = featured[mine]
                    mine = mine[featured[mine]]
                    own, entry_bucket, mass = n, bucket[lo:hi], scaled
                    if not has.all():
                        own, chosen = n[has], np.repeat(has, n)
                        entry_bucket, mass = entry_bucket[chosen], scaled[chosen]
                    if not len(entry_bucket):
                        continue
                    some, among = np.unique(group[mine], return_inverse=True)
                    cell = np.repeat(among * span, own) + entry_bucket
                    if not (w[mine] == 1).all():
                        mass = mass * np.repeat(w[mine], own)
                    if len(some) * span > HELD_CELLS:
                        found, cell = np.unique(cell, return_inverse=True)
                        size = len(found)
                    else:
                        found, size = None, len(some) * span
                    # the number of entries is all there is to sum where each counts once
                    entries = np.bincount(cell, minlength=size).astype(float)
                    sums = [
                        entries if (x[mine] == 1).all() else np.bincount(cell, np.repeat(x[mine], own), size) for x in (w, counted)
                    ]
                    sums = [sums[0], np.bincount(cell, mass, size), sums[1], entries]
                    if found is not None:
                        yield cells(keys, some[found // span], pa.array(found % span, pa.int32()), sums[:3])
                        continue
                    sums = np.stack(sums).reshape(4, len(some), span)
                    for i, number in enumerate(some):
                        if not sums[3, i].any():
                            continue
                        key = keys[number]
                        kept = held.get(key)
                        if kept is None or kept.shape[1] < span:
                            wide = np.zeros((4, max(span, 0 if kept is None else kept.shape[1])))
                            if kept is not None:
                                wide[:, : kept.shape[1]] = kept
                            kept = held[key] = wide
                        kept[:, :span] += sums[:, i]
                    if sum(x.shape[1] for x in held.values()) > HELD_CELLS:
                        yield from release()
        yield from release()

    return run


def feature_violations(rows: DataFrame, value: str, model_type: str) -> DataFrame:
    """How many long-form values the model type would reject."""
    return rows.agg(
        F.count("*").alias("n_values"),
        F.expr(f"count_if({violation(sql.name(value), model_type)}) AS n_rejected"),
    )


@dataclass(frozen=True)
class Model:
    """A fitted model over the (durable or lazy) cell table."""

    cells: DataFrame
    params: Params
    runs: tuple[int, ...] = field(default=(0,))
    is_frozen: bool = False

    @cached_property
    def prior(self) -> DataFrame:
        p = self.params
        if p.model_type == "bernoulli":
            denom = f"ln(n + 2 * {sql.literal(p.smoothing)})"
        else:
            denom = f"ln(mass + {p.n_features} * {sql.literal(p.smoothing)})"
        lam = sql.literal(p.smoothing)
        per_class = self.cells.groupBy("run", "label").agg(
            F.expr("sum(CASE WHEN bucket < 0 THEN weight ELSE 0D END) AS n"),
            F.expr("sum(mass) AS mass"),
            F.expr("count_if(bucket >= 0) AS seen"),
            F.expr("sum(CASE WHEN bucket < 0 THEN df ELSE 0 END) AS n_rows"),
        )
        return per_class.where("n > 0").selectExpr(
            "run", "label", "n", "mass", "seen", "n_rows",
            f"ln(n + {lam}) - ln(sum(n) OVER (PARTITION BY run)"
            f" + count(*) OVER (PARTITION BY run) * {lam}) AS pi",
            f"{denom} AS log_denom",
        )

    @cached_property
    def theta(self) -> DataFrame:
        prior = self.prior.select("run", "label", "log_denom")
        if self.is_frozen:
            # k rows of exact size: a shuffle would meet in k tasks only
            prior = durable(prior, "prior")
        lam = sql.literal(self.params.smoothing)
        return (
            self.cells.where("bucket >= 0")
            .join(prior, ["run", "label"])
            .selectExpr(
                "run", "label", "bucket", "mass", "df",
                f"ln(mass + {lam}) - log_denom AS log_theta",
            )
        )

    def frozen(self, name: str = "cells") -> Model:
        """The same model over a cell table written to the shared folder, once."""
        if self.is_frozen:
            return self
        return Model(durable(self.cells, name), self.params, self.runs, True)

    def restricted(self, runs: Sequence[int]) -> Model:
        kept = self.cells.where(F.col("run").isin(list(runs)))
        return Model(kept, self.params, tuple(runs), self.is_frozen)


def fit(rows: DataFrame, params: Params) -> Model:
    """Fit on labelled rows; lazy until the model is used or frozen."""
    return Model(class_cells(rows.where(F.col(params.label).isNotNull()), params), params)


def full_theta(model: Model) -> DataFrame:
    """The whole class x feature matrix in long form, unseen cells included."""
    p = model.params
    cells = model.prior.selectExpr(
        "run", "label", "log_denom", f"explode(sequence(0, {p.n_features - 1})) AS bucket"
    )
    seen = model.theta.select("run", "label", "bucket", "log_theta")
    unseen = f"ln({sql.literal(p.smoothing)}) - log_denom"
    return cells.join(seen, ["run", "label", "bucket"], "left").selectExpr(
        "run", "label", "bucket", f"coalesce(log_theta, {unseen}) AS log_theta"
    )
