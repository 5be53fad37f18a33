"""Scoring documents with fitted models.

Scores use the raw counts, although the fit normalises them.  Two equal ways:

* ``inline``: the model is a dense matrix, sent once to every executor; each
  document is scored inside its own row.  Nothing is shuffled.  A model of more
  than ``Params.inline_cells`` cells is refused before anything is collected.
* ``joined``: for any size.  Term counts meet the weights of all runs in a join on
  the feature, and the products are summed per document.

The caller names the way; no size picks it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.functions import sql
from labelspring.functions.vectors import length_of
from labelspring.operators.joins import HOT
from labelspring.plans.bayes import Model, Params
from labelspring.runtime import durable

# Scores closer than this are a tie, won by the first label.
TIE = 1e-9
JOINED_SLOTS = 96  # (run, class) sums of one joined pass; what generated code takes in one piece
WAYS = ("inline", "joined")


@dataclass(frozen=True)
class DenseModel:
    """One or more models as arrays on the driver; only built when their size is checked.

    First axis runs, second axis classes in label order.  A run that lacks a
    class has n = 0 there and never predicts it.
    """

    params: Params
    runs: tuple[int, ...]
    labels: tuple
    n: np.ndarray
    n_rows: np.ndarray
    mass: np.ndarray
    df: np.ndarray

    @staticmethod
    def from_cells(cells: pa.Table, params: Params, runs: Sequence[int], labels: Sequence) -> DenseModel:
        runs, labels = tuple(runs), tuple(labels)
        shape = len(runs), len(labels)
        n, n_rows = np.zeros(shape), np.zeros(shape)
        mass = np.zeros((*shape, params.n_features))
        df = np.zeros((*shape, params.n_features))
        run = _positions(cells["run"], runs)
        label = _positions(cells["label"], labels)
        bucket = cells["bucket"].to_numpy()
        weight, m, d = (cells[c].to_numpy() for c in ("weight", "mass", "df"))
        row = bucket < 0
        np.add.at(n, (run[row], label[row]), weight[row])
        np.add.at(n_rows, (run[row], label[row]), d[row])
        at = run[~row], label[~row], bucket[~row]
        mass[at], df[at] = m[~row], d[~row]
        return DenseModel(params, runs, labels, n, n_rows, mass, df)

    @property
    def present(self) -> np.ndarray:
        return self.n > 0

    @cached_property
    def pi(self) -> np.ndarray:
        lam = self.params.smoothing
        total = self.n.sum(axis=1) + self.present.sum(axis=1) * lam
        with np.errstate(divide="ignore"):
            pi = np.log(self.n + lam) - np.log(total)[:, None]
        return np.where(self.present, pi, -np.inf)

    @cached_property
    def theta(self) -> np.ndarray:
        lam, v = self.params.smoothing, self.params.n_features
        if self.params.model_type == "bernoulli":
            denom = np.log(self.n + 2.0 * lam)
        else:
            denom = np.log(self.mass.sum(axis=2) + v * lam)
        return np.log(self.mass + lam) - denom[:, :, None]

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """``(bias, weights)`` of the linear score, one row per (run, class)."""
        bias, theta = self.pi, self.theta
        if self.params.model_type == "bernoulli":
            # absent features count as well: fold ln(1 - e^theta) into the bias
            absent = np.log1p(-np.exp(theta))
            bias, theta = bias + absent.sum(axis=2), theta - absent
        return bias.reshape(-1), theta.reshape(-1, self.params.n_features)

    def log_probs(self) -> dict[int, tuple[float, float]]:
        """Per run: model log-probability in bits, data log-probability in nats."""
        out = {}
        for i, run in enumerate(self.runs):
            has = self.present[i]
            pi, theta = self.pi[i, has], self.theta[i, has]
            out[run] = (
                float(-(pi.sum() + theta.sum()) / np.log(2.0)),
                float((self.n_rows[i, has] * pi).sum() + (self.df[i, has] * theta).sum()),
            )
        return out

    def restricted(self, runs: Sequence[int]) -> DenseModel:
        keep = [self.runs.index(r) for r in runs]
        return DenseModel(
            self.params, tuple(runs), self.labels,
            self.n[keep], self.n_rows[keep], self.mass[keep], self.df[keep],
        )


def _positions(column: pa.ChunkedArray, values: Sequence) -> np.ndarray:
    """Index of every entry in ``values``; looks up distinct entries only."""
    coded = column.combine_chunks().dictionary_encode()
    at = {v: i for i, v in enumerate(values)}
    found = np.array([at[v] for v in coded.dictionary.to_pylist()], dtype=np.int64)
    return found[coded.indices.to_numpy()]


def class_rows(model: Model) -> list:
    """The prior table on the driver: one row per (run, class)."""
    rows = model.prior.collect()
    if not rows:
        raise ValueError("the model has no class: no labelled row was given")
    return rows


def labels_of(cells: DataFrame) -> tuple:
    """Sorted labels of a cell table; touches only the rows that stand for documents."""
    found = cells.where(F.col("bucket") < 0).select("label").distinct().collect()
    if not found:
        raise ValueError("the model has no class: no labelled row was given")
    return tuple(sorted(r["label"] for r in found))


def runs_at_once(way: str, params: Params, n_classes: int) -> int:
    """How many runs one pass may score; an error where not even one fits."""
    if way not in WAYS:
        raise ValueError(f"unknown way {way!r}; use one of {WAYS}")
    if way == "joined":
        return max(1, JOINED_SLOTS // max(1, n_classes))
    size = params.inline_cells // max(1, n_classes * params.n_features)
    if size < 1:
        raise ValueError(
            f"{n_classes} classes x {params.n_features} features exceed inline_cells ="
            f" {params.inline_cells}; use way='joined'"
        )
    return size


def _row_scorer(spark, bias: np.ndarray, weights: np.ndarray):
    """Arrow function: per row, bias plus the weighted counts of each model row."""
    # a feature's weights side by side, since an entry takes them all
    shared = spark.sparkContext.broadcast((bias, np.ascontiguousarray(weights.T)))

    @F.arrow_udf("array<double>")
    def score(buckets: pa.Array, counts: pa.Array) -> pa.Array:
        b, w = shared.value
        n, m = len(buckets), len(b)
        ends = buckets.offsets.to_numpy()
        start = counts.offsets.to_numpy()[0] - ends[0]
        index, value = buckets.values.to_numpy(), counts.values.to_numpy().astype(np.float64)
        out = np.tile(b, (n, 1))
        for row in np.flatnonzero(np.diff(ends)):
            lo, hi = ends[row], ends[row + 1]
            out[row] += value[lo + start : hi + start] @ w[index[lo:hi]]
        offsets = pa.array(np.arange(0, (n + 1) * m, m, dtype=np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)))

    return score


def _presence(counts: str, model_type: str) -> str:
    """What a count contributes to the score: itself, or only its presence."""
    if model_type == "bernoulli":
        return f"transform({counts}, x -> CAST(x <> 0 AS INT))"
    return counts


def with_raw_inline(rows: DataFrame, model: DenseModel) -> DataFrame:
    """Add ``raw``: one score per (run, class), without a shuffle."""
    score = _row_scorer(rows.sparkSession, *model.weights())
    p = model.params
    values = F.expr(_presence(sql.name(p.counts), p.model_type))
    return rows.withColumn("raw", score(F.col(p.buckets), values))


def _absent_bias(model: Model, unseen: np.ndarray, slots: dict) -> np.ndarray:
    """Per (run, class): ln(1 - e^theta) over all features, unseen cells in closed form."""
    base = np.log1p(-np.exp(unseen))
    out = model.params.n_features * base
    sums = model.theta.groupBy("run", "label").agg(
        F.sum(F.log1p(-F.exp("log_theta"))).alias("s"), F.count("*").alias("c")
    )
    for r in sums.collect():
        i = slots[r["run"], r["label"]]
        out[i] += r["s"] - r["c"] * base[i]
    return out


def packed_weights(model: Model, slots: dict, floor: np.ndarray) -> DataFrame:
    """``(bucket, _w)``: one row per seen feature with its weights for all (run, class) slots.

    Weights are differences to the value of an unseen cell, so a missing one is zero.  The
    table is written once; the array has one entry for each slot, at most JOINED_SLOTS or one run.
    """
    n = len(slots)
    number = F.create_map(*[
        F.lit(x) for (run, label), i in slots.items() for x in (f"{run}:{label}", i)
    ])
    theta = F.col("log_theta")
    if model.params.model_type == "bernoulli":
        theta = theta - F.log1p(-F.exp(theta))
    cells = model.theta.select(
        "bucket", F.element_at(number, F.concat_ws(":", "run", F.col("label").cast("string"))).alias("_slot"), theta.alias("_theta")
    )
    base = F.array(*[F.lit(float(x)) for x in floor])
    cells = cells.select("bucket", "_slot", (F.col("_theta") - F.get(base, F.col("_slot"))).alias("_x"))
    packed = cells.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("_slot", "_x"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return durable(packed.select("bucket", dense.alias("_w")), "weights")


def frequent_features(rows: DataFrame, params: Params) -> DataFrame:
    """``(bucket, _copies)`` of the features with more than one of HOT terms, at most HOT of them.

    A feature's terms are dealt out over its copies, so that none of them gets more than a
    fixed share of all terms.  Depends on the rows alone: one table serves all epochs and models.
    """
    # outer, or the planner would put a size filter below and make the buckets twice
    terms = rows.select(F.explode_outer(params.buckets).alias("bucket")).where(F.col("bucket").isNotNull())
    counts = durable(terms.groupBy("bucket").agg(F.count("*").alias("n")), "feature_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    copies = F.ceil(F.col("n") * (8 * HOT) / F.lit(max(1, total))).cast("int").alias("_copies")
    return durable(counts.where(F.col("n") * HOT > total).select("bucket", copies), "frequent")


def with_raw_joined(
    rows: DataFrame, model: Model, labels: Sequence, id_col: str, frequent: DataFrame | None = None
) -> DataFrame:
    """Score by a join on the feature, all runs of the model at once.

    Every seen feature is one row with an array of weights, one for each (run, class), so
    the model is shuffled once whatever the number of runs.  The terms of a ``frequent``
    feature would gather in one task; only such features are repeated, once for each copy.
    """
    if frequent is None:
        frequent = frequent_features(rows, model.params)
    p = model.params
    slots = {(r, x): i for i, (r, x) in enumerate((r, x) for r in model.runs for x in labels)}
    prior = {(r["run"], r["label"]): r for r in class_rows(model)}
    pi = np.array([prior[s]["pi"] if s in prior else -np.inf for s in slots])
    unseen = np.array([np.log(p.smoothing) - prior[s]["log_denom"] if s in prior else 0.0 for s in slots])
    if p.model_type == "bernoulli":
        # a class without rows has no cells; any finite value does for it
        base = np.where(np.isfinite(pi), unseen, -1.0)
        bias, floor = pi + _absent_bias(model, base, slots), base - np.log1p(-np.exp(base))
    else:
        bias, floor = pi, unseen
    weights = packed_weights(model, slots, floor)
    values = F.expr(_presence(sql.name(p.counts), p.model_type))
    terms = (
        rows.select(id_col, values.alias("_values"), F.posexplode_outer(p.buckets).alias("_pos", "bucket"))
        .where(F.col("bucket").isNotNull())
        .select(id_col, "bucket", F.get("_values", F.col("_pos")).cast("double").alias("_tf"))
    )
    few = F.broadcast(frequent)
    salt = F.pmod(F.xxhash64(id_col), F.coalesce("_copies", F.lit(1))).cast("int")
    terms = terms.join(few, "bucket", "left").withColumn("_salt", salt).drop("_copies")
    salts = F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1)
    weights = weights.join(few, "bucket", "left").withColumn("_salt", F.explode(salts)).drop("_copies")
    each = [F.sum(F.col("_tf") * F.get("_w", F.lit(i))).alias(f"_s{i}") for i in range(len(slots))]
    sums = terms.join(weights, ["bucket", "_salt"]).groupBy(id_col).agg(*each)
    # documents without any seen feature have no sum and keep the base score
    total = F.expr(length_of(_presence(sql.name(p.counts), p.model_type)))
    raw = F.array(*[
        F.lit(float(bias[i])) + F.col("_total") * F.lit(float(floor[i])) + F.coalesce(F.col(f"_s{i}"), F.lit(0.0))
        for i in range(len(slots))
    ])
    return (
        rows.withColumn("_total", total)
        .join(sums, id_col, "left")
        .withColumn("raw", raw)
        .drop("_total", *[f"_s{i}" for i in range(len(slots))])
    )


def posterior_of(raw: str) -> str:
    """SQL: softmax of the raw scores, shifted by the largest one."""
    shifted = "transform(r, x -> exp(x - array_max(r)))"
    total = "aggregate(e, 0D, (acc, x) -> acc + x)"
    shares = sql.bind("t", total, "transform(e, x -> x / t)")
    return sql.bind("r", raw, sql.bind("e", shifted, shares))


def best_of(raw: str) -> str:
    """SQL: 0-based position of the largest score, the first one on a tie."""
    near = f"transform(r, x -> x >= array_max(r) - {TIE:.9f}D)"
    return sql.bind("r", raw, f"CAST(array_position({near}, true) - 1 AS INT)")


def label_at(position: str, labels: Sequence) -> str:
    return f"get({sql.array(labels)}, {position})"


def with_raw(
    rows: DataFrame, model: Model, labels: Sequence, id_col: str, way: str = "inline"
) -> DataFrame:
    """Add ``raw``: one score per (run, label), run after run.

    ``model`` should be frozen: it is read here, when the plan is built.
    """
    if len(model.runs) > runs_at_once(way, model.params, len(labels)):
        raise ValueError(f"{len(model.runs)} runs do not fit one {way} pass")
    if way == "joined":
        # read three times
        return with_raw_joined(durable(rows, "rows"), model, labels, id_col)
    return with_raw_inline(
        rows, DenseModel.from_cells(model.cells.toArrow(), model.params, model.runs, labels)
    )


def transform(
    rows: DataFrame, model: Model, id_col: str = "doc_id", way: str = "inline", keep_scores: bool = True
) -> DataFrame:
    """Add ``raw``, ``posterior`` (arrays over the sorted labels) and ``prediction``."""
    model = model.frozen()
    labels = labels_of(model.cells)
    scored = with_raw(rows, model, labels, id_col, way)
    best = F.expr(label_at(best_of("raw"), labels))
    if not keep_scores:
        return scored.withColumn("prediction", best).drop("raw")
    return scored.withColumn("posterior", F.expr(posterior_of("raw"))).withColumn("prediction", best)


def class_scores(scored: DataFrame, labels: Sequence, *keep: str) -> DataFrame:
    """Long form ``(keep..., label, raw, posterior)`` of scored rows."""
    kept = [sql.name(c) for c in keep]
    return scored.selectExpr(*kept, "posterior", "posexplode_outer(raw) AS (_pos, raw)").selectExpr(
        *kept, f"{label_at('_pos', labels)} AS label", "raw", "get(posterior, _pos) AS posterior"
    )
