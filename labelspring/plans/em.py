"""Expectation maximisation over labelled and unlabelled documents.

Each epoch is one pass over the term counts: score every row, give the
unlabelled ones their best class, and aggregate the class cells of the combined
set.  Class sizes, training and test hits come out of the same aggregate, and
the log-probabilities follow from its result.  Documents stay where they are;
only (class, feature) sums are shuffled.  At the end of the epoch those become
the next model: as arrays on the driver while their size is within the inline
limit, as a table in the shared folder beyond it.  Plans never grow with the
epochs.

Several runs, which differ in which rows are labelled, share every pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.functions import sql
from labelspring.functions.vectors import checked, length_of
from labelspring.plans import scoring
from labelspring.plans.journal import Journal
from labelspring.plans.bayes import Model, Params, class_cells, role
from labelspring.plans.likelihood import LN2, log_probs, relative_difference
from labelspring.runtime import durable, spread

WEIGHTINGS = ("hard", "row", "soft")

# Row markers; see ROW in bayes.  Test rows never reach the model.
LABELLED_HIT, LABELLED_MISS, UNLABELLED, TEST_HIT, TEST_MISS = -1, -2, -3, -4, -5

KEEPS = ("cache", "table")

TRACE_SCHEMA = (
    "run int, epoch int, acc_test double, acc_train double, n_label0 bigint, n_label1 bigint, "
    "ratio double, model_log_prob double, data_log_prob double, log_prob double, improvement double"
)


@dataclass(frozen=True)
class EMParams:
    """``weighting``: ``hard`` counts every row once, ``row`` gives unlabelled rows
    ``unlabeled_weight``, ``soft`` also spreads them over the classes by posterior.

    ``way`` as in :mod:`scoring`.  ``keep`` says where the rows stay between epochs:
    in the executors' memory and disks (``cache``) or in the shared folder (``table``)."""

    max_epoch: int = 20
    min_improvement: float = 0.0
    unlabeled_weight: float = 1.0
    weighting: str = "hard"
    unit: str = "mixed"
    way: str = "inline"
    keep: str = "cache"

    def __post_init__(self):
        if self.max_epoch < 1:
            raise ValueError("max_epoch must be at least 1")
        if self.weighting not in WEIGHTINGS:
            raise ValueError(f"unknown weighting {self.weighting!r}; use one of {WEIGHTINGS}")
        if self.way not in scoring.WAYS:
            raise ValueError(f"unknown way {self.way!r}; use one of {scoring.WAYS}")
        if self.keep not in KEEPS:
            raise ValueError(f"unknown keep {self.keep!r}; use one of {KEEPS}")
        if self.unlabeled_weight < 0:
            raise ValueError("unlabeled_weight must not be negative")


@dataclass(frozen=True)
class EMResult:
    model: Model
    trace: DataFrame
    epochs: dict[int, int]
    supervised: Model


def em_rows(
    labelled: DataFrame, unlabelled: DataFrame, test: DataFrame | None, params: Params, id_col: str
) -> DataFrame:
    """The three inputs as one frame: ``part``, ``known`` (runs that see the label)."""
    base = [id_col, params.buckets, params.counts]
    label = params.label
    kind = labelled.schema[label].dataType
    none = F.array().cast("array<int>")

    def part(df: DataFrame, name: str, truth: Column, known: Column) -> DataFrame:
        return df.select(*base, truth.alias(label), F.lit(name).alias("part"), known.alias("known"))

    frames = [
        part(labelled, "train", F.col(label), F.array(F.lit(0))),
        part(unlabelled, "train", F.lit(None).cast(kind), none),
    ]
    if test is not None:
        frames.append(part(test, "test", F.col(label), none))
    return reduce(DataFrame.unionByName, frames)


def partial_rows(
    df: DataFrame, params: Params, id_col: str, is_test: Column | None = None
) -> DataFrame:
    """The same shape from one frame whose label is null where it is unknown.

    Test rows keep their label for the accuracy and stay out of the training.
    """
    test = F.lit(False) if is_test is None else F.coalesce(is_test, F.lit(False))
    none = F.array().cast("array<int>")
    known = F.when(~test & F.col(params.label).isNotNull(), F.array(F.lit(0))).otherwise(none)
    return df.select(
        id_col, params.label, params.buckets, params.counts,
        F.when(test, "test").otherwise("train").alias("part"),
        known.alias("known"),
    )


def _per_run(runs: Sequence[int], n_classes: int, *fields: str) -> str:
    """SQL: one struct per run, from the scores of that run (named ``own``)."""
    body = ", ".join(["'run', run", *fields])
    scores = sql.bind("own", f"slice(raw, i * {n_classes} + 1, {n_classes})", f"named_struct({body})")
    return f"transform({sql.array(runs)}, (run, i) -> {scores})"


def _free_weight(em: EMParams, weights: Mapping[int, float] | None) -> str:
    """SQL: weight of an unlabelled row, which may differ by the run of its role ``a``."""
    if weights is None or em.weighting == "hard":
        return sql.literal(1.0 if em.weighting == "hard" else float(em.unlabeled_weight))
    own = " ".join(f"WHEN {int(r)} THEN {sql.literal(float(w))}" for r, w in weights.items())
    return f"(CASE a.run {own} ELSE {sql.literal(float(em.unlabeled_weight))} END)"


def _assignments(
    rows: DataFrame,
    params: Params,
    em: EMParams,
    labels: Sequence,
    runs: Sequence[int],
    weights: Mapping[int, float] | None = None,
) -> DataFrame:
    """The rows with their ``roles``: class, weight and marker in every run, as class_cells takes them."""
    label, buckets, counts = (sql.name(c) for c in (params.label, params.buckets, params.counts))
    soft = em.weighting == "soft"
    # a row is a test row of all runs, or of those that its column ``held`` names
    test = "array_contains(held, run)" if "held" in rows.columns else "(part = 'test')"
    fields = [
        f"'test', {test}", f"'settled', {test} OR array_contains(known, run)",
        f"'guess', {scoring.label_at(scoring.best_of('own'), labels)}",
    ]
    if soft:
        fields.append(f"'posterior', {scoring.posterior_of('own')}")
    each = _per_run(runs, len(labels), *fields)
    if "used" in rows.columns:
        # rows may be left out of some runs altogether
        each = f"filter({each}, a -> array_contains(used, a.run))"
    length = "row_length" if "row_length" in rows.columns else length_of(counts)
    marker = (
        f"CASE WHEN a.test THEN IF({label} <=> a.guess, {TEST_HIT}, {TEST_MISS})"
        f" WHEN {buckets} IS NULL THEN NULL WHEN NOT a.settled THEN {UNLABELLED}"
        f" WHEN {label} <=> a.guess THEN {LABELLED_HIT} ELSE {LABELLED_MISS} END"
    )
    hard = f"CASE WHEN a.settled THEN {label} ELSE a.guess END"
    free = _free_weight(em, weights)
    if not soft:
        weight = f"CASE WHEN a.settled THEN 1D ELSE {free} END"
        roles = f"transform({each}, a -> {role('a.run', hard, weight, '1', marker, 'NOT a.test')})"
    else:
        single = f"array({role('a.run', hard, '1', '1', marker, 'NOT a.test')})"
        spread = role("a.run", "c", f"get(a.posterior, i) * {free}", "c <=> a.guess", marker, "NOT a.test")
        spread = f"transform({sql.array(labels)}, (c, i) -> {spread})"
        roles = f"flatten(transform({each}, a -> CASE WHEN a.settled THEN {single} ELSE {spread} END))"
    return rows.selectExpr(label, buckets, counts, f"{length} AS row_length", f"{roles} AS roles")


def _epoch_metrics(markers: list[dict], run: int) -> dict:
    own = [m for m in markers if m["run"] == run]

    def rows_of(*buckets: int) -> int:
        return sum(m["df"] for m in own if m["bucket"] in buckets)

    def share(hit: int, miss: int) -> float | None:
        total = rows_of(hit, miss)
        return rows_of(hit) / total if total else None

    def labelled_as(value) -> int:
        return sum(m["df"] for m in own if m["bucket"] >= UNLABELLED and m["label"] == value)

    zero, one = labelled_as(0), labelled_as(1)
    return {
        "acc_test": share(TEST_HIT, TEST_MISS),
        "acc_train": share(LABELLED_HIT, LABELLED_MISS),
        "n_label0": zero,
        "n_label1": one,
        "ratio": zero / (zero + one) if zero + one else None,
    }


class _DenseState:
    """Model kept as arrays on the driver: an epoch is a single Spark job."""

    def __init__(self, model: scoring.DenseModel, cells: pa.Table | None = None):
        self.model, self.cells = model, cells

    def with_raw(self, rows: DataFrame, id_col: str) -> DataFrame:
        return scoring.with_raw_inline(rows, self.model)

    def advance(self, stats: DataFrame, epoch: int) -> tuple[_DenseState, list[dict]]:
        table = stats.toArrow()
        markers = table.filter(pc.field("bucket") < 0).to_pylist()
        cells = table.filter(pc.field("bucket") >= UNLABELLED)
        m = self.model
        dense = scoring.DenseModel.from_cells(cells, m.params, m.runs, m.labels)
        return _DenseState(dense, cells), markers

    def log_probs(self) -> dict[int, tuple[float, float]]:
        return self.model.log_probs()

    def restricted(self, runs: Sequence[int]) -> _DenseState:
        return _DenseState(self.model.restricted(runs), self._cells_of(runs))

    def _cells_of(self, runs: Sequence[int]) -> pa.Table:
        return self.cells.filter(pc.field("run").isin(list(runs)))

    def finished_cells(self, runs: Sequence[int], like: DataFrame) -> DataFrame:
        return durable(self.as_table(runs, like), "model")

    def as_table(self, runs: Sequence[int], like: DataFrame) -> DataFrame:
        return like.sparkSession.createDataFrame(self._cells_of(runs), like.schema)

    def restored(self, cells: DataFrame, runs: Sequence[int]) -> _DenseState:
        table = cells.toArrow()
        return _DenseState(scoring.DenseModel.from_cells(table, self.model.params, runs, self.model.labels), table)


class _TableState:
    """Model kept as a table in the shared folder, for sizes beyond the inline limit."""

    def __init__(self, model: Model, labels: Sequence, frequent: DataFrame):
        self.model, self.labels, self.frequent = model, labels, frequent

    def with_raw(self, rows: DataFrame, id_col: str) -> DataFrame:
        return scoring.with_raw_joined(rows, self.model, self.labels, id_col, self.frequent)

    def advance(self, stats: DataFrame, epoch: int) -> tuple[_TableState, list[dict]]:
        table = durable(stats, f"epoch{epoch}")
        markers = [r.asDict() for r in table.where(F.col("bucket") < 0).collect()]
        cells = table.where(F.col("bucket") >= UNLABELLED)
        model = Model(cells, self.model.params, self.model.runs, True)
        return _TableState(model, self.labels, self.frequent), markers

    def log_probs(self) -> dict[int, tuple[float, float]]:
        rows = log_probs(self.model).collect()
        return {r["run"]: (r["model_log_prob"], r["data_log_prob"]) for r in rows}

    def restricted(self, runs: Sequence[int]) -> _TableState:
        return _TableState(self.model.restricted(runs), self.labels, self.frequent)

    def finished_cells(self, runs: Sequence[int], like: DataFrame) -> DataFrame:
        return self.as_table(runs, like)

    def as_table(self, runs: Sequence[int], like: DataFrame) -> DataFrame:
        return self.model.restricted(runs).cells

    def restored(self, cells: DataFrame, runs: Sequence[int]) -> _TableState:
        return _TableState(Model(cells, self.model.params, tuple(runs), True), self.labels, self.frequent)


def run_em(
    rows: DataFrame,
    params: Params,
    em: EMParams = EMParams(),
    id_col: str = "doc_id",
    runs: Sequence[int] = (0,),
    cache: bool = True,
    weights: Mapping[int, float] | None = None,
    journal: str | None = None,
    stop_after: int | None = None,
    supervised: Model | None = None,
) -> EMResult:
    """Run EM for every run over ``rows`` as built by :func:`em_rows`.

    Optional array columns give a row another role in every run: ``used`` names the runs
    it takes part in, ``held`` those it is a test row of.  ``weights`` gives runs an
    unlabelled weight of their own.

    ``journal`` names a folder of the shared store.  Every finished epoch is recorded there,
    and a call with the same settings goes on behind the last one, in whatever session.
    ``stop_after`` ends the call after that epoch; the result then holds what there is so far.
    ``supervised`` is the first model where an earlier call over the same rows has fitted it.

    A run stops when its relative change falls below ``min_improvement``; the
    others go on.  Runs share their passes as far as :func:`scoring.runs_at_once` allows.
    """
    runs = tuple(runs)
    if weights is not None and em.weighting == "hard":
        raise ValueError("hard weighting counts every row once; use 'row' or 'soft' with weights")
    with prepared(rows, params, id_col, cache, em.keep) as kept:
        if cache:
            # the kept rows have been checked
            params = replace(params, validate=False)
        size = len(runs)
        if size > 1:
            k = kept.where("size(known) > 0").select(params.label).distinct().count()
            size = scoring.runs_at_once(em.way, params, k)
        parts = []
        for i in range(0, len(runs), size):
            some = runs[i : i + size]
            settings = [asdict(params), asdict(em), some, weights]
            log = journal and Journal(kept.sparkSession, f"{journal}/runs{i}", settings)
            parts.append(_loop(kept, params, em, id_col, some, weights, log, stop_after, supervised and supervised.restricted(some)))
    return parts[0] if len(parts) == 1 else _combined(parts, params, runs)


@contextmanager
def prepared(
    rows: DataFrame, params: Params, id_col: str = "doc_id", cache: bool = True, keep: str = "cache"
):
    """The rows, checked and with their lengths, computed once for all epochs.

    Several EM runs over the same rows can share this with ``cache=False``.
    ``keep="cache"`` holds them in the executors' memory or on their disks, with the
    lineage back to the scan; ``keep="table"`` in the shared folder, which outlives any executor.
    """
    if not cache:
        yield rows
        return
    value = checked("x", params.model_type) if params.validate else "CAST(x AS DOUBLE)"
    length = f"aggregate({sql.name(params.counts)}, 0D, (acc, x) -> acc + {value})"
    rows = spread(rows, id_col).withColumn("row_length", F.expr(length))
    if keep == "table":
        yield durable(rows, "rows")
        return
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def _combined(parts: list[EMResult], params: Params, runs: tuple[int, ...]) -> EMResult:
    def joined(pick) -> DataFrame:
        return reduce(DataFrame.unionByName, [pick(p) for p in parts])

    return EMResult(
        Model(joined(lambda p: p.model.cells), params, runs, True),
        joined(lambda p: p.trace),
        {k: v for p in parts for k, v in p.epochs.items()},
        Model(joined(lambda p: p.supervised.cells), params, runs, True),
    )


def _loop(
    rows: DataFrame,
    params: Params,
    em: EMParams,
    id_col: str,
    runs: tuple[int, ...],
    weights: Mapping[int, float] | None,
    journal: Journal | None = None,
    stop_after: int | None = None,
    given: Model | None = None,
) -> EMResult:
    spark = rows.sparkSession
    seed_rows = (
        rows.where((F.col("part") == "train") & (F.size("known") > 0))
        .select(
            F.explode("known").alias("run"), params.label, params.buckets, params.counts,
            *[c for c in rows.columns if c == "row_length"],
        )
        .where(F.col("run").isin(list(runs)))
    )
    first = class_cells(seed_rows, params) if given is None else given.cells
    if journal:
        supervised = Model(journal.kept("supervised", first), params, runs, True)
    elif given is not None:
        supervised = given
    else:
        supervised = Model(first, params, runs).frozen("supervised")
    labels = scoring.labels_of(supervised.cells)
    if len(runs) > scoring.runs_at_once(em.way, params, len(labels)):
        raise ValueError(f"{len(runs)} runs do not fit one {em.way} pass")
    if em.way == "inline":
        cells = supervised.cells.toArrow()
        dense = scoring.DenseModel.from_cells(cells, params, runs, labels)
        state: _DenseState | _TableState = _DenseState(dense, cells)
    else:
        state = _TableState(supervised, labels, scoring.frequent_features(rows, params))

    active = runs
    last: dict[int, float] = {}
    trace: list[dict] = []
    finished: list[DataFrame] = []
    epochs: dict[int, int] = {}
    done_before = journal.last() if journal else None
    if done_before:
        trace = done_before["trace"]
        for t in trace:
            epochs[t["run"]], last[t["run"]] = t["epoch"], t["log_prob"]
        finished = [journal.table(name) for name in done_before["finished"]]
        active = tuple(done_before["active"])
        if active:
            state = state.restored(journal.table(done_before["cells"]), active)
    for epoch in range(done_before["epoch"] + 1 if done_before else 1, em.max_epoch + 1 if active else 0):
        scored = state.with_raw(rows, id_col)
        stats = class_cells(_assignments(scored, params, em, labels, active, weights), params)
        state, markers = state.advance(stats, epoch)
        logs = state.log_probs()
        done = []
        for run in active:
            bits, nats = logs[run]
            total = bits + nats / (LN2 if em.unit == "bits" else 1.0)
            change = relative_difference(total, last.get(run))
            trace.append(
                {
                    "run": run,
                    "epoch": epoch,
                    **_epoch_metrics(markers, run),
                    "model_log_prob": bits,
                    "data_log_prob": nats,
                    "log_prob": total,
                    "improvement": change,
                }
            )
            epochs[run], last[run] = epoch, total
            if epoch == em.max_epoch or (change is not None and change < em.min_improvement):
                done.append(run)
        if done:
            cells = state.finished_cells(done, supervised.cells)
            finished.append(journal.write(f"finished{epoch}", cells) if journal else cells)
            active = tuple(r for r in active if r not in done)
        if active:
            state = state.restricted(active)
        if journal:
            state = journal.close_epoch(epoch, state, active, trace, supervised.cells)
        if not active:
            break
        if epoch == stop_after:
            finished.append(state.finished_cells(active, supervised.cells))
            break
    columns = [c.split(" ")[0] for c in TRACE_SCHEMA.split(", ")]
    frame = spark.createDataFrame([[t[c] for c in columns] for t in trace], TRACE_SCHEMA)
    final = Model(reduce(DataFrame.unionByName, finished), params, runs, True)
    return EMResult(final, frame, epochs, supervised)


def em_step(
    rows: DataFrame, model: Model, em: EMParams = EMParams(), id_col: str = "doc_id"
) -> Model:
    """One E-step and M-step: the refitted model over the combined set."""
    model = model.frozen()
    labels = scoring.labels_of(model.cells)
    scored = scoring.with_raw(rows, model, labels, id_col, em.way)
    cells = class_cells(_assignments(scored, model.params, em, labels, model.runs), model.params)
    return Model(cells.where(F.col("bucket") >= UNLABELLED), model.params, model.runs)


def pseudo_labelled(
    unlabelled: DataFrame, model: Model, unlabeled_weight: float = 1.0, id_col: str = "doc_id", way: str = "inline"
) -> DataFrame:
    """E-step output: prediction as label, posterior as weight, fixed ground truth."""
    return (
        scoring.transform(unlabelled, model, id_col, way)
        .drop("raw", *([model.params.label] if model.params.label in unlabelled.columns else []))
        .withColumnRenamed("posterior", "weight")
        .withColumnRenamed("prediction", model.params.label)
        .withColumn("groundTruth", F.lit(float(unlabeled_weight)))
    )


def run_accuracy(rows: DataFrame, model: Model, id_col: str = "doc_id", way: str = "inline") -> DataFrame:
    """``(run, n_rows, accuracy)`` of every run of the model on labelled rows.

    With a column ``held``, a run is tested on the rows that name it there.
    """
    model = model.frozen()
    labels = scoring.labels_of(model.cells)
    k = len(labels)
    size = scoring.runs_at_once(way, model.params, k)
    parts = []
    for first in range(0, len(model.runs), size):
        part = model.restricted(model.runs[first : first + size])
        best = _per_run(part.runs, k, f"'best', {scoring.best_of('own')}")
        if "held" in rows.columns:
            best = f"filter({best}, a -> array_contains(held, a.run))"
        label = sql.name(model.params.label)
        guesses = scoring.with_raw(rows, part, labels, id_col, way).selectExpr(
            label, f"explode({best}) AS _a"
        )
        hits = f"count_if({label} = {scoring.label_at('_a.best', labels)})"
        parts.append(
            guesses.groupBy(F.col("_a.run").alias("run")).agg(
                F.expr("count(*) AS n_rows"), F.expr(f"{hits} / count(*) AS accuracy")
            )
        )
    return reduce(DataFrame.unionByName, parts)
