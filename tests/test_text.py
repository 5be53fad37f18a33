import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import functions as F

import brute
from labelspring.functions.stopwords import ENGLISH_STOP_WORDS
from labelspring.functions.text import (
    TOKEN_PATTERN,
    bucket_of,
    explode_counts,
    hashed_counts,
    regex_tokens,
    space_tokens,
    with_hashed_counts,
    without_stop_words,
)

TEXTS = [
    "Hello, hello WORLD_again 42x", "", "a b c 1 2", "été déjà-vu Ünder", "line one\nline\ttwo",
    "++plus+minus--", "  lead and trail  ", "same same same", None, "x" * 5000,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def test_tokens_match_ml_tokenizer_and_python(spark):
    texts = [t for t in TEXTS if t is not None]
    df = frame(spark, texts)
    ours = {r.doc_id: r.w for r in df.selectExpr("doc_id", f"{regex_tokens('text')} AS w").collect()}
    ml = RegexTokenizer(inputCol="text", outputCol="w", pattern=TOKEN_PATTERN, minTokenLength=2)
    theirs = {r.doc_id: r.w for r in ml.transform(df).collect()}
    assert ours == theirs == {i: brute.tokens(t) for i, t in enumerate(texts)}


def test_null_text_has_no_token(spark):
    assert frame(spark, [None]).selectExpr(f"{regex_tokens('text')} AS w").first().w == []


def test_space_tokens_keep_empty_ones(spark):
    row = frame(spark, ["a  b "]).selectExpr(f"{space_tokens('text')} AS w").first()
    assert row.w == ["a", "", "b", ""]


def test_stop_words_are_sparks(spark):
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_stop_word_removal_matches_ml(spark):
    df = frame(spark, ["The cat sat ON the mat"]).selectExpr("split(text, ' ') AS w")
    ml = StopWordsRemover(inputCol="w", outputCol="k").transform(df).first().k
    assert df.selectExpr(f"{without_stop_words('w')} AS k").first().k == ml == ["cat", "sat", "mat"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcXYZ éß09_+\n.", max_size=60), min_size=1, max_size=20))
def test_hashed_counts_match_python(spark, texts):
    rows = with_hashed_counts(frame(spark, texts), regex_tokens("text"), 7, keep=("doc_id",)).collect()
    for r in rows:
        want = brute.counts(texts[r.doc_id], 7)
        assert dict(zip(r.buckets, r.counts)) == want
        assert r.buckets == sorted(r.buckets)
        assert r.n_terms == sum(want.values())


def test_long_form_drops_only_empty_documents(spark):
    long = explode_counts(with_hashed_counts(frame(spark, TEXTS), regex_tokens("text"), 50), "doc_id")
    want = {
        (i, b, n) for i, t in enumerate(TEXTS) if t for b, n in brute.counts(t, 50).items()
    }
    assert {(r.doc_id, r.bucket, r.tf) for r in long.collect()} == want


def test_filter_above_counts_stays_linear(spark):
    long_text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20000))
    rows = with_hashed_counts(frame(spark, [long_text]), regex_tokens("text"), 1000)
    assert rows.where(F.size("buckets") > 3).count() == 1


@pytest.mark.parametrize("term", ["abc", "zzzzzzzzzzzz", "Aa", "BB", "polynomial"])
def test_java_hash(spark, term):
    got = spark.sql(f"SELECT {bucket_of(repr(term), 1000, 'java')} AS b").first().b
    assert got == brute.java_hash(term) % 1000


def test_murmur_counts_keep_the_total(spark):
    rows = with_hashed_counts(frame(spark, TEXTS), regex_tokens("text"), 16, "murmur3").collect()
    assert all(sum(r.counts) == r.n_terms == len(brute.tokens(r.text or "")) for r in rows)


def test_unknown_hash_and_size_are_rejected(spark):
    with pytest.raises(ValueError):
        bucket_of("t", 10, "crc")
    with pytest.raises(ValueError):
        with_hashed_counts(frame(spark, ["a"]), regex_tokens("text"), 0)


def test_java_hash_uses_utf16_units(spark):
    assert spark.sql(f"SELECT {bucket_of(repr('😀ok'), 1000, 'java')} AS b").first().b == 487


def test_batched_counts_are_those_of_sql(spark):
    words = [["b", "a", "b", None, None], [], None, ["é", "b", None], ["x"]]
    rows = spark.createDataFrame(list(enumerate(words)), "doc_id int, w array<string>")
    got = with_hashed_counts(rows, "w", 7, keep=("doc_id",))
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
    want = rows.selectExpr("doc_id", f"{hashed_counts('w', 7)} AS h").selectExpr("doc_id", "h.*")
    assert got.orderBy("doc_id").collect() == want.orderBy("doc_id").collect()
