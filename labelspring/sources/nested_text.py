"""Numbers in nested brackets: ``(1.0, (5,[0,3],[1,2]), [0,1], 2)``.

A tuple ``( )`` holds numbers, arrays and tuples, an array ``[ ]`` numbers; a comma needs an item
before it, and may be the last thing before a close.  What follows the first complete value
is ignored.  The line is checked by a stack machine over its tokens: one aggregate per
row, whose state is the stack of open brackets, so nesting has no limit and nothing is shuffled.
Plain numbers that each have a comma behind them are one token, as they leave any open bracket as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from labelspring.functions import sql

ITEM = r"[^()\[\],]+"
TOKEN = rf"[()\[\],]|{ITEM}"
# behind a bracket or comma only: what stands first in a line may be the whole value
RUN = r"(?<=[()\[\],])(?:[0-9]++(?:\.[0-9]++)?+,){1,200}+"
BLANK = r"^[\x00-\x20]*$"
# the same inside a line; ``$`` lets one line end of Unicode stand behind the blanks
BLANK_ITEM = r"(?<=^|[()\[\],])(?:[\x00-\x20]++[\u0085\u2028\u2029]?+|[\u0085\u2028\u2029])(?=$|[()\[\],])"

NO_TOKEN, BAD_COMMA, MISSING_CLOSE, BAD_NUMBER = "no token", "bad comma", "missing close", "bad number"


def _state(stack: str = "s.stack", comma: str = "s.comma", error: str = "CAST(NULL AS STRING)") -> str:
    """SQL: the state behind one more token; ``at`` counts the tokens taken in."""
    return f"named_struct('stack', {stack}, 'comma', {comma}, 'at', s.at + 1, 'error', {error})"


def _step() -> str:
    push, pop = "concat(s.stack, t)", "left(s.stack, length(s.stack) - 1)"
    top = "right(s.stack, 1)"
    number = f"IF(try_cast(t AS DOUBLE) IS NULL, {_state(error=sql.literal(BAD_NUMBER))}, {_state(comma='true')})"
    comma = f"IF(s.comma, {_state(comma='false')}, {_state(error=sql.literal(BAD_COMMA))})"
    return f"""CASE
        WHEN s.error IS NOT NULL OR (s.at > 0 AND s.stack = '') THEN s
        WHEN right(t, 1) = ',' AND t <> ',' THEN {_state(comma='false')}
        WHEN t IN ('(', '[') AND {top} <> '[' THEN {_state(push, 'false')}
        WHEN s.stack = '' THEN {number}
        WHEN t = ',' THEN {comma}
        WHEN t = IF({top} = '(', ')', ']') THEN {_state(pop, 'true')}
        WHEN {top} = '(' AND t RLIKE {sql.literal(BLANK)} THEN {_state()}
        ELSE {number} END"""


def checked_tokens(line: str) -> str:
    """SQL: struct of ``tokens`` (those of the first value), ``error`` and ``error_at``.

    ``error_at`` is the place of the offending token, counted in characters from 1; a missing
    close is at the end of the line.
    """
    start = "named_struct('stack', '', 'comma', false, 'at', 0, 'error', CAST(NULL AS STRING))"
    final = f"aggregate(a, {start}, (s, t) -> {_step()})"
    before = "aggregate(slice(a, 1, greatest(f.at - 1, 0)), 0, (n, t) -> n + length(t))"
    error = f"""CASE WHEN size(a) = 0 THEN {sql.literal(NO_TOKEN)} WHEN f.error IS NOT NULL THEN f.error
        WHEN f.stack <> '' THEN {sql.literal(MISSING_CLOSE)} END"""
    place = f"""CASE WHEN size(a) = 0 THEN 1 WHEN f.error IS NOT NULL THEN {before} + 1
        WHEN f.stack <> '' THEN aggregate(a, 0, (n, t) -> n + length(t)) + 1 END"""
    result = f"named_struct('tokens', slice(a, 1, f.at), 'error', {error}, 'error_at', {place})"
    tokens = f"regexp_extract_all(coalesce({line}, ''), {sql.literal(f"{RUN}|{TOKEN}")}, 0)"
    return sql.bind("a", tokens, sql.bind("f", final, result))


def parse_nested(df: DataFrame, line: str = "value") -> DataFrame:
    """Add ``shape``, ``numbers``, ``error`` and ``error_at``.

    ``shape`` is the value with ``n`` for every number and without blanks, ``numbers`` are its
    numbers in order, so both together are the value; a bad line has neither.
    """
    names = ("shape", "numbers", "error", "error_at")
    kept = [sql.name(c) for c in df.columns if c not in names]
    checked = df.selectExpr(*[sql.name(c) for c in df.columns], f"{checked_tokens(sql.name(line))} AS _checked")
    value = checked.selectExpr(*kept, "_checked.error", "_checked.error_at", "IF(_checked.error IS NULL, array_join(_checked.tokens, ''), NULL) AS _value")
    shape = f"regexp_replace(regexp_replace(_value, {sql.literal(BLANK_ITEM)}, ''), {sql.literal(ITEM)}, 'n')"
    items = f"regexp_extract_all(_value, {sql.literal(ITEM)}, 0)"
    return value.selectExpr(
        *kept,
        f"{shape} AS shape",
        f"filter(transform({items}, t -> try_cast(t AS DOUBLE)), x -> x IS NOT NULL) AS numbers",
        "error",
        "error_at",
    )
