"""The bracket grammar against a character-wise reading of the same rules; ordered lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labelspring.sources import nested_text, text


def number(token):
    try:
        return float(token) if not re.search(r"_|^\s*$", token) else None
    except ValueError:
        return None


def expected(line):
    """(shape, numbers, error, error_at), by recursion over the tokens."""
    tokens = re.findall(nested_text.TOKEN, line or "")
    starts = [0]
    for t in tokens:
        starts.append(starts[-1] + len(t))
    if not tokens:
        return None, None, "no token", 1

    class Bad(Exception):
        pass

    def group(i, close):
        """Items from token i on; the token behind the close."""
        comma = False
        while i < len(tokens):
            t = tokens[i]
            if close == ")" and t in "([":
                i = group(i + 1, ")" if t == "(" else "]")
                comma = True
                continue
            if t == ",":
                if not comma:
                    raise Bad("bad comma", starts[i] + 1)
                comma = False
            elif t == close:
                return i + 1
            elif close == ")" and not t.strip():
                pass
            elif number(t) is None:
                raise Bad("bad number", starts[i] + 1)
            else:
                comma = True
            i += 1
        raise Bad("missing close", starts[-1] + 1)

    try:
        if tokens[0] in "([":
            end = group(1, ")" if tokens[0] == "(" else "]")
        elif number(tokens[0]) is None:
            raise Bad("bad number", 1)
        else:
            end = 1
    except Bad as bad:
        return (None, None, *bad.args)
    used = tokens[:end]
    shape = "".join(t if t in "()[]," else "n" if t.strip() else "" for t in used)
    return shape, [number(t) for t in used if t not in "()[]," and t.strip()], None, None


LINES = [
    None, "", " ", "5", " 5.5 tail", "x", ",", ")", "(1,2)", "(1,2))", "[1, 2,]", "[,1]", "[1,,2]", "(1,,2)", "( 1 , [2,3] , (4,(5)) )", "[(1)]", "[[1]]",
    "(1]", "(1", "[1", "((1)", "(a)", "(1,2,x)", "[1, ]", "( )", "[]", "()", "(1 2)", "((((1))))", "(1)(2)", "1(2", "[1e3,-2.5E-1]", "((1,2),,3)",
]


def check(spark, lines):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    got = {r.i: (r.shape, r.numbers, r.error, r.error_at) for r in nested_text.parse_nested(rows).collect()}
    for i, line in enumerate(lines):
        assert got[i] == expected(line), line


def test_given_lines(spark):
    check(spark, LINES)


def test_random_lines(spark):
    rng = random.Random(4)
    items = ["(", ")", "[", "]", ",", "1", " 2", "3.5", " ", "x"]
    weights = [3, 3, 2, 2, 5, 5, 2, 2, 1, 0.3]
    check(spark, ["".join(rng.choices(items, weights, k=rng.randrange(14))) for _ in range(2000)])


def test_depth_has_no_limit(spark):
    n = 3000
    deep = "(" * n + "7" + ")" * n
    lines = {"whole": deep, "open": deep[:-1], "behind": deep + "x", "inside": "(" * n + "x" + ")" * n}
    rows = spark.createDataFrame(list(lines.items()), "name string, value string")
    got = {r.name: (r.shape, r.numbers, r.error, r.error_at) for r in nested_text.parse_nested(rows).collect()}
    fine = ("(" * n + "n" + ")" * n, [7.0], None, None)
    assert got == {
        "whole": fine, "behind": fine, "open": (None, None, "missing close", 2 * n + 1), "inside": (None, None, "bad number", n + 1)
    }
    check(spark, ["(" + "1," * 4000 + ")"])


def test_columns_of_the_input_stay(spark):
    rows = spark.createDataFrame([("(1)", "keep", 3)], "value string, other string, error int")
    out = nested_text.parse_nested(rows)
    assert out.columns == ["value", "other", "shape", "numbers", "error", "error_at"] and out.first().error is None


@pytest.mark.parametrize("block", ["300b", "128m"])
def test_lines_of_split_files_keep_their_order(spark, tmp_path, block):
    lines = {name: [f"{name} line {i} " + "x" * (i % 37) for i in range(n)] for name, n in (("a", 400), ("b", 1), ("c", 57))}
    for name, content in lines.items():
        (tmp_path / name).write_text("\n".join(content) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        read = text.read_ordered_lines(spark, str(tmp_path))
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 20 or block != "300b"
    got = {}
    for r in read.withColumn("name", F.element_at(F.split("filename", "/"), -1)).collect():
        got.setdefault(r.name, {})[r.line] = r.value
    assert got == {name: dict(enumerate(content)) for name, content in lines.items()}


def test_plain_numbers_are_one_token(spark):
    """A long list is few steps of the stack machine; what is first in a line stays a token of its own."""
    lines = spark.createDataFrame([("(" + "1,2.5," * 50 + "3)",), ("1,2,3",), ("(1,2,x,4)",), ("(1,2,,3)",)], "value string")
    sizes = [r.n for r in lines.selectExpr(f"size({nested_text.checked_tokens('value')}.tokens) AS n").collect()]
    assert sizes[:2] == [4, 1]
    parsed = nested_text.parse_nested(lines).collect()
    assert parsed[0].numbers == [1.0, 2.5] * 50 + [3.0] and parsed[0].shape == "(" + "n," * 100 + "n)"
    assert (parsed[1].shape, parsed[1].numbers) == ("n", [1.0])
    assert [(r.error, r.error_at) for r in parsed[2:]] == [("bad number", 6), ("bad comma", 6)]


def test_variants_of_a_line_read_the_documents_once(spark, tmp_path):
    from labelspring.catalog.queries import QUERIES

    spark.createDataFrame([(1, "ab cd ab"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = QUERIES["nested_numbers"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert found.count() == 10
