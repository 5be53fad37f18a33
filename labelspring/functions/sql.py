"""Rendering values and names into SQL expressions.

The nested array expressions of this package are written as SQL text: one
parsed expression reads better than dozens of chained column calls, and costs
one call into the JVM instead of dozens.
"""

from __future__ import annotations

from collections.abc import Sequence


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    raise TypeError(f"no SQL literal for {type(value).__name__}")


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def array(values: Sequence) -> str:
    return "array(" + ", ".join(literal(v) for v in values) + ")"


def bind(variable: str, value: str, body: str) -> str:
    """``body`` with ``variable`` standing for ``value``, evaluated once per row.

    A plain intermediate column may be substituted into the lambdas that use it
    when the optimizer moves a filter below it, and would then be evaluated
    again for every element.
    """
    return f"get(transform(array({value}), {variable} -> {body}), 0)"
