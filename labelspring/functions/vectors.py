"""Vector helpers on plain arrays, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelspring.functions import sql


def one_hot(label: str, n_classes: int) -> str:
    """Dense class-weight vector: 1.0 at the label, 0.0 elsewhere."""
    return f"transform(sequence(0, {int(n_classes) - 1}), j -> CASE WHEN j = {label} THEN 1D ELSE 0D END)"


def length_of(values: str) -> str:
    """Sum of the entries."""
    return f"aggregate({values}, 0D, (acc, x) -> acc + CAST(x AS DOUBLE))"


def length_multiplier(length: str, norm: float = 1.0) -> str:
    """``norm / length``, and 1.0 for a document without length."""
    return f"(CASE WHEN {length} > 0 THEN {sql.literal(float(norm))} / {length} ELSE 1D END)"


def normalise(values: str, norm: float = 1.0) -> str:
    """Scale an array so that it sums to ``norm``."""
    scaled = f"transform({values}, x -> CAST(x AS DOUBLE) * k)"
    return sql.bind("k", sql.bind("n", length_of(values), length_multiplier("n", norm)), scaled)


def vector_entries(df: DataFrame, values: str, *keep: str) -> DataFrame:
    """Long form ``(keep..., bucket, value)`` of a dense array column."""
    kept = [sql.name(c) for c in keep]
    return df.selectExpr(*kept, f"posexplode({sql.name(values)}) AS (bucket, value)")


def violation(value: str, model_type: str) -> str:
    """True where a feature value is not allowed for the model type."""
    if model_type == "bernoulli":
        return f"({value} NOT IN (0, 1))"
    return f"({value} < 0 OR isnan({value}))"


def checked(value: str, model_type: str) -> str:
    """The value itself, or a job failure naming the first bad one."""
    kind = "0 or 1" if model_type == "bernoulli" else "nonnegative"
    message = f"concat('{model_type} features must be {kind}, found ', {value})"
    return (
        f"(CASE WHEN {violation(value, model_type)} THEN CAST(raise_error({message}) AS DOUBLE)"
        f" ELSE CAST({value} AS DOUBLE) END)"
    )


def certainty(posterior: str, low: float = 0.05, high: float = 0.8, positional: bool = False) -> str:
    """Gap between the two best posteriors, scaled to 0..1 between the bounds.

    ``positional=True`` takes entry 0 minus entry 1 without ranking them.
    """
    ordered = posterior if positional else f"sort_array({posterior}, false)"
    gap = f"coalesce(get(p, 0), 0D) - coalesce(get(p, 1), 0D) - {sql.literal(float(low))}"
    scaled = f"greatest(0D, least(1D, ({gap}) / {sql.literal(float(high - low))}))"
    return sql.bind("p", ordered, scaled)
