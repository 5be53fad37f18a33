"""Repeated trials over labelled-set sizes, all cells of the grid in shared passes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspring.functions import sql
from labelspring.operators import sampling
from labelspring.operators.labels import smallest_class
from labelspring.operators.splits import unit_hash, window_offset
from labelspring.plans.bayes import Model, Params, class_cells
from labelspring.plans.em import EMParams, EMResult, run_accuracy, run_em


@dataclass(frozen=True)
class Cell:
    run: int
    n_sup: int
    trial: int
    start: int


def balanced_grid(
    min_class: int, sizes: Sequence[int], trials: int, seed: int
) -> list[Cell]:
    """One cell per (size, trial), each with its own seeded window start."""
    cells = [(n, t) for n in sizes for t in range(1, trials + 1)]
    return [
        Cell(i, n, t, window_offset(min_class, n, seed, t)) for i, (n, t) in enumerate(cells)
    ]


def known_runs(cells: Sequence[Cell], ind: str = "ind") -> Column:
    """Runs whose window holds the row.

    Membership is an expression over the row's index, so the grid multiplies
    neither the rows nor the passes.
    """
    windows = ", ".join(
        f"named_struct('run', {c.run}, 'first', {c.start}L, 'last', {c.start + c.n_sup}L)" for c in cells
    )
    mine = f"filter(array({windows}), w -> {ind} >= w.first AND {ind} < w.last)"
    return F.expr(f"transform({mine}, w -> w.run)")


def grid_rows(
    train: DataFrame, test: DataFrame, known: Column, params: Params, id_col: str
) -> DataFrame:
    """Train rows with the runs that see their label, and test rows, in the shape EM takes."""
    base = [id_col, params.label, params.buckets, params.counts]
    return train.select(*base, F.lit("train").alias("part"), known.alias("known")).unionByName(
        test.select(
            *base, F.lit("test").alias("part"), F.array().cast("array<int>").alias("known")
        )
    )


def trial_grid(
    train: DataFrame,
    test: DataFrame,
    params: Params,
    sizes: Sequence[int],
    trials: int,
    seed: int,
    em: EMParams = EMParams(),
    id_col: str = "doc_id",
) -> tuple[DataFrame, EMResult]:
    """``(n_sup, trial, start, n_rows, acc_sup, acc_em, epochs)`` per cell.

    ``train`` needs ``ind``, the index of the row inside its class.
    """
    spark = train.sparkSession
    min_class = smallest_class(train, params.label).first()["min_class"]
    cells = balanced_grid(min_class, sizes, trials, seed)
    rows = grid_rows(train, test, known_runs(cells), params, id_col)
    result = run_em(rows, params, em, id_col, [c.run for c in cells])
    table = spark.createDataFrame(
        [(c.run, c.n_sup, c.trial, c.start, result.epochs[c.run]) for c in cells],
        "run int, n_sup int, trial int, start bigint, epochs int",
    )
    grid = table.join(accuracies(test, result, id_col, em), "run")
    return grid.select("n_sup", "trial", "start", "n_rows", "acc_sup", "acc_em", "epochs"), result


def accuracies(test: DataFrame, result: EMResult, id_col: str, em: EMParams) -> DataFrame:
    """``(run, n_rows, acc_sup, acc_em)``: of the supervised model and of the last one."""
    supervised = result.trace.where(F.col("epoch") == 1).select("run", F.col("acc_test").alias("acc_sup"))
    final = run_accuracy(test, result.model, id_col, em.way).withColumnRenamed("accuracy", "acc_em")
    return supervised.join(final, "run")


def random_grid(
    train: DataFrame,
    test: DataFrame,
    params: Params,
    sizes: Sequence[int],
    trials: int,
    seed: int,
    em: EMParams = EMParams(),
    id_col: str = "doc_id",
) -> tuple[DataFrame, EMResult]:
    """``(n_sup, trial, n_labelled, n_label0, n_rows, acc_sup, acc_em, epochs)`` per (size, trial).

    Every run labels an exact random sample of ``n_sup`` train rows, whatever their class, and
    hides the labels of the rest.  ``n_label0`` counts its rows of class 0.
    """
    chosen = sampling.draws(train, id_col, sizes, trials, seed)
    known = sampling.drawn_runs(chosen, id_col, seed)
    rows = grid_rows(train, test, known, params, id_col)
    result = run_em(rows, params, em, id_col, [d.run for d in chosen])
    counts = rows.select(params.label, F.explode("known").alias("run")).groupBy("run").agg(
        F.count("*").alias("n_labelled"), F.count_if(F.col(params.label) == 0).alias("n_label0")
    )
    table = train.sparkSession.createDataFrame(
        [(d.run, d.size, d.trial, result.epochs[d.run]) for d in chosen], "run int, n_sup int, trial int, epochs int"
    )
    grid = table.join(counts, "run").join(accuracies(test, result, id_col, em), "run")
    return grid.select("n_sup", "trial", "n_labelled", "n_label0", "n_rows", "acc_sup", "acc_em", "epochs"), result


# Weight of an unlabelled row in the two variants of the balanced grid.
VARIANT_WEIGHTS = {"full": 1.0, "reduced": 0.5}


def weighted_grid(
    train: DataFrame,
    test: DataFrame,
    params: Params,
    sizes: Sequence[int],
    trials: int,
    seed: int,
    em: EMParams = EMParams(weighting="row"),
    weights: dict[str, float] = VARIANT_WEIGHTS,
    id_col: str = "doc_id",
) -> tuple[DataFrame, EMResult]:
    """``(n_sup, trial, start, n_rows, acc_sup, acc_<variant>...)``: EM with several weights in every cell.

    The variants of a cell see the same labelled window.  Each is a run of its own, so all
    cells and variants are fitted and scored in the same passes.
    """
    spark = train.sparkSession
    min_class = smallest_class(train, params.label).first()["min_class"]
    cells = balanced_grid(min_class, sizes, trials, seed)
    k = len(weights)
    runs = [Cell(k * c.run + i, c.n_sup, c.trial, c.start) for c in cells for i in range(k)]
    rows = grid_rows(train, test, known_runs(runs), params, id_col)
    result = run_em(
        rows, params, em, id_col, [c.run for c in runs], weights={c.run: w for c, w in zip(runs, [*weights.values()] * len(cells))}
    )
    table = spark.createDataFrame(
        [(c.run, c.n_sup, c.trial, c.start, v) for c, v in zip(runs, [*weights] * len(cells))],
        "run int, n_sup int, trial int, start bigint, variant string",
    )
    named = table.join(accuracies(test, result, id_col, em), "run")
    columns = [F.max(F.when(F.col("variant") == v, F.col("acc_em"))).alias(f"acc_{v}") for v in weights]
    grid = named.groupBy("n_sup", "trial", "start", "n_rows").agg(F.max("acc_sup").alias("acc_sup"), *columns)
    return grid, result


def compare_on_samples(
    train: DataFrame,
    test: DataFrame,
    variants: dict[str, Params],
    cells: Sequence[Cell],
    id_col: str = "doc_id",
    way: str = "inline",
) -> DataFrame:
    """``(variant, n_sup, trial, n_rows, accuracy)``: supervised accuracy of several
    parameter sets on the same balanced samples.

    Variants that differ only in ``normalise`` are runs of one model: one aggregate fits them,
    one pass over the test rows scores them.
    """
    n = len(cells)
    # on the index alone, so that rows outside every window are dropped before any work
    inside = train.where(F.col("ind") < max(c.start + c.n_sup for c in cells))
    inside = inside.where(F.col("ind") >= min(c.start for c in cells))
    alike: dict[Params, list[str]] = {}
    for name, params in variants.items():
        alike.setdefault(replace(params, normalise=True), []).append(name)
    out = []
    for params, names in alike.items():
        each = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(not variants[v].normalise).alias("raw")) for i, v in enumerate(names)])
        sample = inside.select(
            F.explode(known_runs(cells)).alias("_cell"), params.label, params.buckets, params.counts
        ).withColumn("_variant", F.explode(each))
        sample = sample.withColumn("run", F.col("_cell") + n * F.col("_variant.at")).withColumn("row_raw", F.col("_variant.raw"))
        runs = {c.run + n * i: (v, c) for i, v in enumerate(names) for c in cells}
        model = Model(class_cells(sample.drop("_cell", "_variant"), params), params, tuple(runs)).frozen("variants")
        table = train.sparkSession.createDataFrame(
            [(run, v, c.n_sup, c.trial) for run, (v, c) in runs.items()], "run int, variant string, n_sup int, trial int"
        )
        done = run_accuracy(test, model, id_col, way).join(table, "run")
        out.append(done.select("variant", "n_rows", "accuracy", "n_sup", "trial"))
    return reduce(DataFrame.unionByName, out)


def share_sweep(
    rows: DataFrame,
    params: Params,
    shares: Sequence[float],
    free_share: float,
    seed: int,
    em: EMParams = EMParams(),
    id_col: str = "doc_id",
) -> DataFrame:
    """``(share, n_rows, acc_sup, acc_em)``: EM with part of the labels and of the rest.

    ``rows`` as EM takes them, for one run.  Every share of the labelled rows is
    a run of its own; labelled rows outside the share are left out of that run.
    """
    runs = range(len(shares))
    u = unit_hash(F.col(id_col), F.lit(seed + 1))
    wanted = F.array(
        *[F.struct(F.lit(i).alias("run"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)]
    )
    labelled = F.size("known") > 0
    own = F.transform(F.filter(wanted, lambda w: F.col("_u") < w["share"]), lambda w: w["run"])
    everyone = F.array(*[F.lit(i) for i in runs])
    free_u = unit_hash(F.col(id_col), F.lit(seed + 2))
    test = F.col("part") == "test"
    swept = (
        rows.withColumn("_u", u)
        .where(test | labelled | (free_u < free_share))
        .select(
            id_col, params.label, params.buckets, params.counts, "part",
            F.when(labelled, own).otherwise(F.col("known")).alias("known"),
            F.when(labelled, own).otherwise(everyone).alias("used"),
        )
    )
    result = run_em(swept, params, em, id_col, list(runs))
    held = rows.where(test).drop("part", "known")
    table = rows.sparkSession.createDataFrame(
        [(i, float(s)) for i, s in enumerate(shares)], "run int, share double"
    )
    return table.join(accuracies(held, result, id_col, em), "run").drop("run")


@dataclass(frozen=True)
class ShareRun:
    run: int
    share: float
    trial: int


def share_roles(rows: DataFrame, runs: Sequence[ShareRun], label: str, free_share: float, test_share: float, seed: int, id_col: str) -> DataFrame:
    """Add ``known``, ``held`` and ``used``: the part a row plays in every run.

    Every trial draws anew: the labelled rows it tests on, the share of the other labelled
    rows, the share of the unlabelled ones.  Shares of one trial are nested.  Rows
    without a part in any run are left out.
    """
    trials = sorted({r.trial for r in runs})
    place = {t: i for i, t in enumerate(trials)}

    def drawn(purpose: int) -> Column:
        return F.array(*[unit_hash(F.col(id_col), F.lit(seed + purpose), F.lit(t)) for t in trials])

    def runs_where(test: str) -> str:
        listed = ", ".join(
            f"named_struct('run', {r.run}, 'at', {place[r.trial]}, 'share', {sql.literal(float(r.share))})" for r in runs
        )
        return f"transform(filter(array({listed}), w -> {test}), w -> w.run)"

    none = "CAST(array() AS ARRAY<INT>)"
    labelled = f"{sql.name(label)} IS NOT NULL"
    is_test = f"get(_t, w.at) >= {sql.literal(1.0 - test_share)}"
    return (
        rows.withColumns({"_t": drawn(0), "_l": drawn(1), "_f": drawn(2)})
        .selectExpr(
            *[sql.name(c) for c in rows.columns if c not in ("known", "held", "used")],
            f"IF({labelled}, {runs_where(f'NOT ({is_test}) AND get(_l, w.at) < w.share')}, {none}) AS known",
            f"IF({labelled}, {runs_where(is_test)}, {none}) AS held",
            f"IF({labelled}, {none}, {runs_where(f'get(_f, w.at) < {sql.literal(float(free_share))}')}) AS _free",
        )
        .withColumn("used", F.concat("known", "held", "_free"))
        .where(F.size("used") > 0)
        .drop("_free")
    )


def share_trials(
    rows: DataFrame,
    params: Params,
    shares: Sequence[float],
    trials: int,
    seed: int,
    em: EMParams = EMParams(),
    free_share: float = 0.1,
    test_share: float = 0.1,
    id_col: str = "doc_id",
) -> tuple[DataFrame, EMResult]:
    """``(share, trial, n_labelled, n_label0, n_unlabelled, n_rows, acc_sup, acc_em)`` per (share, trial).

    ``rows`` have a null label where it is unknown.
    """
    runs = [ShareRun(i, s, t) for i, (s, t) in enumerate((s, t) for s in shares for t in range(1, trials + 1))]
    base = [id_col, params.label, params.buckets, params.counts]
    parted = share_roles(rows.select(*base), runs, params.label, free_share, test_share, seed, id_col)
    parted = parted.withColumn("part", F.lit("train"))
    result = run_em(parted, params, em, id_col, [r.run for r in runs])
    labelled = F.expr("array_contains(known, run)")
    counts = parted.select(params.label, "known", "held", F.explode("used").alias("run")).groupBy("run").agg(
        F.count_if(labelled).alias("n_labelled"),
        F.count_if(labelled & (F.col(params.label) == 0)).alias("n_label0"),
        F.count_if(~labelled & ~F.expr("array_contains(held, run)")).alias("n_unlabelled"),
    )
    table = rows.sparkSession.createDataFrame([(r.run, float(r.share), r.trial) for r in runs], "run int, share double, trial int")
    tested = parted.where(F.size("held") > 0)
    done = table.join(counts, "run").join(accuracies(tested, result, id_col, em), "run")
    return done.select("share", "trial", "n_labelled", "n_label0", "n_unlabelled", "n_rows", "acc_sup", "acc_em"), result
