"""Log-gamma as a column expression, built from logarithms alone.

Above SHIFT the asymptotic series in 1/x is used; its first omitted term is below 2e-15
there.  Smaller arguments are moved up by the recurrence, negative ones by reflection.
"""

from __future__ import annotations

import math

from labelspring.functions import sql

SHIFT = 9  # arguments below are raised to at least this

# Coefficients of 1/x, 1/x^3, 1/x^5, ... of the series.
SERIES = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)

HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def _series(x: str) -> str:
    """SQL: ln Gamma(x) for x of at least SHIFT."""
    body = sql.literal(SERIES[-1])
    for c in reversed(SERIES[:-1]):
        body = f"({sql.literal(c)} + {body} * q)"
    return sql.bind("q", f"1D / ({x} * {x})", f"({x} - 0.5D) * ln({x}) - {x} + {sql.literal(HALF_LOG_2PI)} + {body} / {x}")


def _positive(x: str) -> str:
    """SQL: ln Gamma(x) for x > 0: the recurrence takes the product of x, x + 1, ... out."""
    product = f"aggregate(sequence(1, {SHIFT} - 1), {x}, (acc, i) -> acc * ({x} + i))"
    raised = sql.bind("z", f"{x} + {SHIFT}", _series("z"))
    return f"CASE WHEN {x} >= {SHIFT} THEN {_series(x)} ELSE {raised} - ln({product}) END"


def log_gamma(value: str) -> str:
    """SQL: ln |Gamma(value)|; infinite at 0 and the negative whole numbers, null for null."""
    # ln |Gamma(x)| = ln pi - ln |sin(pi x)| - ln Gamma(1 - x)
    reflected = sql.bind("y", "1D - v", f"{sql.literal(math.log(math.pi))} - ln(abs(sin(pi() * (v - rint(v))))) - ({_positive('y')})")
    infinite = "CAST('Infinity' AS DOUBLE)"
    body = (
        f"CASE WHEN v IS NULL OR isnan(v) THEN v WHEN abs(v) = {infinite} THEN {infinite}"
        f" WHEN v > 0 THEN {_positive('v')} WHEN v = floor(v) THEN {infinite} ELSE {reflected} END"
    )
    return sql.bind("v", f"CAST({value} AS DOUBLE)", body)


def log2_gamma(value: str) -> str:
    """SQL: the same in bits."""
    return f"({log_gamma(value)}) / {sql.literal(math.log(2.0))}"
