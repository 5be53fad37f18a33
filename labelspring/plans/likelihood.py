"""Log-probabilities of models and data, from the class tables alone.

The data term sums, over rows, the prior of the row's label and the weight of
every feature present.  Grouped by (label, feature) that is the number of rows
times one cell of the model, so no second pass over the documents is needed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspring.functions.gamma import log_gamma
from labelspring.plans.bayes import Model

LN2 = math.log(2.0)


def _class_sums(model: Model) -> DataFrame:
    """Per class: prior columns and the sum of log-likelihoods over all features."""
    v = model.params.n_features
    seen = model.theta.groupBy("run", "label").agg(
        F.sum("log_theta").alias("_seen_sum"),
        F.sum(F.col("df") * F.col("log_theta")).alias("_df_sum"),
        F.max("log_theta").alias("_largest"),
    )
    unseen_cell = F.lit(math.log(model.params.smoothing)) - F.col("log_denom")
    unseen = unseen_cell * (v - F.col("seen"))
    return model.prior.join(seen, ["run", "label"], "left").select(
        "run", "label", "n", "n_rows", "pi", "seen",
        (F.coalesce("_seen_sum", F.lit(0.0)) + unseen).alias("theta_sum"),
        (F.col("n_rows") * F.col("pi") + F.coalesce("_df_sum", F.lit(0.0))).alias("data_sum"),
        F.greatest("_largest", F.when(F.col("seen") < v, unseen_cell)).alias("largest"),
    )


def model_log_prob(model: Model) -> DataFrame:
    """``-(sum pi + sum theta) / ln 2`` over all classes and features, per run."""
    return _class_sums(model).groupBy("run").agg(
        (-(F.sum("pi") + F.sum("theta_sum")) / LN2).alias("model_log_prob")
    )


def data_log_prob(model: Model) -> DataFrame:
    """Natural-log probability of the rows the model was fitted on, per run."""
    return _class_sums(model).groupBy("run").agg(F.sum("data_sum").alias("data_log_prob"))


def log_probs(model: Model, unit: str = "mixed") -> DataFrame:
    """Both terms and their total, per run.

    ``mixed`` adds the model term in bits to the data term in nats, which is
    what the stop rule is tuned to; ``bits`` converts the data term as well.
    """
    if unit not in ("mixed", "bits"):
        raise ValueError("unit must be 'mixed' or 'bits'")
    data = F.sum("data_sum") / (LN2 if unit == "bits" else 1.0)
    return (
        _class_sums(model)
        .groupBy("run")
        .agg(
            (-(F.sum("pi") + F.sum("theta_sum")) / LN2).alias("model_log_prob"),
            data.alias("data_log_prob"),
        )
        .withColumn("log_prob", F.col("model_log_prob") + F.col("data_log_prob"))
    )


def relative_change(x: Column, y: Column) -> Column:
    """``2|x - y| / (|x| + |y|)``, null where there is nothing to compare with."""
    return F.try_divide(2.0 * F.abs(x - y), F.abs(x) + F.abs(y))


def with_relative_change(trace: DataFrame) -> DataFrame:
    """Add ``improvement`` over the previous epoch of the same run."""
    previous = F.lag("log_prob").over(Window.partitionBy("run").orderBy("epoch"))
    return trace.withColumn("improvement", relative_change(F.col("log_prob"), previous))


def relative_difference(x: float, y: float | None) -> float | None:
    if y is None or abs(x) + abs(y) == 0:
        return None
    return 2.0 * abs(x - y) / (abs(x) + abs(y))


def dirichlet_log2_prior(model: Model, alpha: float) -> DataFrame:
    """Symmetric Dirichlet log2 density of every class's feature distribution."""
    if not (math.isfinite(alpha) and alpha > 0):
        raise ValueError("alpha must be positive and finite")
    v = model.params.n_features
    constant = (math.lgamma(v * alpha) - v * math.lgamma(alpha)) / LN2
    density = F.lit(constant) + (alpha - 1.0) * F.col("theta_sum") / LN2
    # a log-probability above zero, beyond rounding, is not a distribution
    improper = F.greatest("largest", F.lit(-math.inf)) > 1e-9
    message = F.lit("feature probabilities must lie between 0 and 1")
    return _class_sums(model).select(
        "run", "label",
        F.when(improper, F.raise_error(message).cast("double")).otherwise(density).alias("dirichlet_log2"),
    )


def dirichlet_log2_prior_by_feature(model: Model, alpha: DataFrame) -> DataFrame:
    """Dirichlet log2 density of every class's feature distribution, with a parameter for each feature.

    ``alpha`` has columns ``bucket`` and ``alpha``, and ``label`` where classes differ; features
    it does not name have a parameter of 1, which leaves the density as it is but counts in the
    normalising constant.  Nothing is collected: the constants are aggregates over ``alpha``,
    and only seen cells meet it in a join, unseen ones share one value per class.
    """
    v = model.params.n_features
    classes = model.prior.select("run", "label", "log_denom")
    by_class = "label" in alpha.columns
    own = alpha.withColumn("alpha", F.col("alpha").cast("double"))
    bad = ~(F.col("alpha") > 0) | F.isnan("alpha") | (F.col("alpha") == math.inf)
    message = F.lit("alpha must be positive and finite")
    own = own.withColumn("alpha", F.when(bad, F.raise_error(message).cast("double")).otherwise(F.col("alpha")))
    keys = ["label"] if by_class else []
    # without classes of its own the table of sums has one row, for the one value of a constant key
    group = keys or ["_all"]
    sums = own.withColumn("_all", F.lit(0)).groupBy(*group).agg(
        F.sum("alpha").alias("_sum"), F.count("*").alias("_named"),
        F.sum(F.expr(log_gamma("alpha"))).alias("_gammas"), F.sum(F.col("alpha") - 1.0).alias("_excess"),
    )
    joined = classes.withColumn("_all", F.lit(0)).join(sums, group, "left")
    filled = joined.fillna({"_sum": 0.0, "_named": 0, "_gammas": 0.0, "_excess": 0.0})
    # parameters of 1 add 1 to the sum and nothing to the log-gammas
    total = F.col("_sum") + (v - F.col("_named"))
    constant = filled.withColumn("_total", total).withColumn("_constant", F.expr(f"{log_gamma('_total')} - _gammas"))
    unseen = F.lit(math.log(model.params.smoothing)) - F.col("log_denom")
    seen = model.theta.join(own, ["bucket", *keys]).join(classes, ["run", "label"])
    above = seen.groupBy("run", "label").agg(
        F.sum((F.col("alpha") - 1.0) * (F.col("log_theta") - unseen)).alias("_above")
    )
    log = F.col("_constant") + F.col("_excess") * unseen + F.coalesce("_above", F.lit(0.0))
    return constant.join(above, ["run", "label"], "left").select("run", "label", (log / LN2).alias("dirichlet_log2"))
