"""Named queries over the test tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspring.catalog import settings as S
from labelspring.functions import vectors
from labelspring.functions.gamma import log_gamma
from labelspring.functions.text import (
    explode_counts,
    flat_tokens,
    regex_tokens,
    space_tokens,
    with_hashed_counts,
    without_stop_words,
)
from labelspring.operators import aggregates, evaluate, labels, sampling, splits
from labelspring.plans import bayes, classifier, em, likelihood, newsgroups, pipeline, scoring, trials
from labelspring.runtime import durable, scratch_path, spread
from labelspring.sources import corpus, labeled_points, nested_text, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PARAMS = bayes.Params(n_features=S.N_FEATURES, smoothing=S.SMOOTHING)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- inputs


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = corpus.read_corpus(spark, f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents", *columns), "doc_id")


def quality(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))


def counted(docs: DataFrame, *keep: str) -> DataFrame:
    """Hashed counts of the documents, all narrow."""
    return with_hashed_counts(docs, regex_tokens("text"), S.N_FEATURES, keep=("doc_id", *keep))


def labelled_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Only the documents with a label are tokenized."""
    docs = documents(spark, folder, "doc_id", "text")
    return counted(docs.join(quality(spark, folder), "doc_id"), "label")


def partly_labelled(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text")
    return counted(docs.join(quality(spark, folder), "doc_id", "left"), "label")


def held_back() -> Column:
    """A tenth of the rows, by id."""
    return splits.split_side(splits.unit_hash(F.col("doc_id"), F.lit(S.SEED)), [9, 1]) == 1


def em_corpus(spark: SparkSession, folder: str) -> DataFrame:
    is_test = held_back() & F.col("label").isNotNull()
    return em.partial_rows(partly_labelled(spark, folder), PARAMS, "doc_id", is_test)


def language_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Language as class: train rows with their index inside the class, and test rows."""
    ids = table(spark, folder, "documents", "doc_id", "lang")
    codes = labels.fit_label_index(ids, "lang")
    coded = labels.apply_label_index(ids, codes, "lang").select("doc_id", "label")
    train_ids = coded.where(~held_back())
    index = labels.topic_instance_index(train_ids, "label", "doc_id").select("doc_id", "label", "ind")
    docs = table(spark, folder, "documents", "doc_id", "text")
    # joined before tokenizing, so that filters on the index reach the text
    train = spread(docs.join(index, "doc_id"), "doc_id")
    test = spread(docs.where(held_back()).join(coded, "doc_id"), "doc_id")
    return counted(train, "label", "ind"), counted(test, "label")


def words_md5(words: str, separator: str = " ") -> Column:
    return F.md5(F.array_join(words, separator))


# ---------------------------------------------------------------- sources and sinks


@query
def path_parts(spark, folder):
    pages = table(spark, folder, "pages", "page_id", "url")
    return pages.selectExpr(
        "page_id", f"{text.path_part('url', 2)} AS topic", f"{text.path_part('url', 1)} AS item"
    )


@query
def file_provenance(spark, folder):
    path = scratch_path(spark, "lines")
    text.write_lines(table(spark, folder, "documents", "source", "text"), path, "source")
    lines = text.read_lines_with_file(spark, path)
    located = text.with_topic_and_id(lines).withColumn(
        "topic", F.regexp_replace("topic", "%3D", "=")
    )
    return located.groupBy("topic").agg(F.count("*").alias("n_lines"))


@query
def text_roundtrip(spark, folder):
    path = scratch_path(spark, "lines")
    text.write_lines(table(spark, folder, "documents", "text"), path)
    lines = text.read_lines(spark, path)
    return lines.groupBy(F.length("value").cast("bigint").alias("line_length")).agg(
        F.count("*").alias("n_lines")
    )


@query
def delimited_fields(spark, folder):
    events = table(spark, folder, "events", "event_id", "user_id", "event_type", "props")

    def read_back(layout: str, separator: str, columns: list[Column], fields: dict[str, int]) -> DataFrame:
        path = scratch_path(spark, layout)
        text.write_lines(events.select(F.concat_ws(separator, *columns)), path)
        lines = text.read_lines(spark, path)

        def field(position: int) -> str:
            return text.delimited_field("value", separator, position)

        words = space_tokens(field(fields["text"]))
        return lines.selectExpr(
            f"'{layout}' AS layout",
            f"{field(0)} AS item",
            f"{field(fields['polarity'])} AS polarity",
            f"array_join({words}, '|') AS words",
            f"size({words}) AS n_words",
            f"CAST({field(9)} IS NULL AS INT) AS missing",
        )

    c = F.col
    comma = [c("event_id"), c("user_id"), F.lit("q"), c("event_type"), F.lit("u"), c("props")]
    tab = [c("event_id"), c("event_type"), c("user_id"), c("props")]
    return read_back("comma", ",", comma, text.COMMA_FIELDS).unionByName(
        read_back("tab", "\t", tab, text.TAB_FIELDS)
    )


def _points(spark, folder) -> DataFrame:
    rows = labelled_counts(spark, folder)
    line = labeled_points.format_point(
        F.col("label"), S.N_FEATURES, F.col("buckets"), F.col("counts"),
        F.expr(vectors.one_hot("label", 2)), F.lit(1.0),
    )
    return rows.select("doc_id", line.alias("line"))


@query
def labeled_point_format(spark, folder):
    return _points(spark, folder)


@query
def labeled_point_parse(spark, folder):
    whole = _points(spark, folder)
    both = whole.select(
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit("whole").alias("variant"), F.col("line")),
                F.struct(F.lit("cut").alias("variant"), F.regexp_replace("line", r"\)$", "").alias("line")),
            )
        ).alias("_v"),
    ).select("doc_id", "_v.variant", "_v.line")
    parsed = labeled_points.parse_points(both, "line")
    return parsed.select(
        "doc_id", "variant", "label", "size",
        F.when(F.col("buckets").isNotNull(), F.size("buckets")).alias("n_active"),
        F.expr(vectors.length_of("values")).alias("total"),
        F.get("weight", F.lit(0)).alias("weight0"),
        F.col("groundTruth").alias("ground_truth"),
        F.col("_corrupt").isNotNull().cast("int").alias("corrupt"),
    )


@query
def parquet_roundtrip(spark, folder):
    path = scratch_path(spark, "corpus")
    docs = table(spark, folder, "documents")
    corpus.write_corpus(docs, path, files=10)
    return corpus.read_corpus(spark, path).select(
        "doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5")
    )


@query
def nested_numbers(spark, folder):
    """Labelled points as nested numbers: whole, and broken in the three ways that have a name."""
    lines = labeled_point_format(spark, folder)
    variants = {
        "whole": "line",
        "cut": "left(line, length(line) - 1)",
        "comma": "concat(left(line, instr(line, ',')), substring(line, instr(line, ',')))",
        "number": "concat('(', 'x', substring(line, 2))",
        "deeper": "concat('((', line, '), [ 1.5,2,])')",
    }
    # one row for each variant of a line that is made once
    each = ", ".join(f"named_struct('variant', '{name}', 'line', {how})" for name, how in variants.items())
    broken = lines.selectExpr("doc_id", f"explode(array({each})) AS _v").selectExpr("doc_id", "_v.variant", "_v.line")
    parsed = nested_text.parse_nested(broken, "line")
    return parsed.selectExpr(
        "doc_id", "variant", "error", "error_at", "md5(shape) AS shape_md5", "size(numbers) AS n_numbers",
        "round(aggregate(numbers, 0D, (s, x) -> s + x), 6) AS total",
    )


@query
def ordered_lines(spark, folder):
    """Texts written line by line, one file for each source, and read back in order."""
    docs = table(spark, folder, "documents", "doc_id", "source", "text")
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    path = scratch_path(spark, "ordered")
    files = lines.repartition("source").sortWithinPartitions("source", "doc_id", "pos")
    text.write_lines(files.select("source", "value"), path, "source")
    read = text.read_ordered_lines(spark, path)
    topic = F.expr(f"substring_index({text.path_part('filename', 2)}, '=', -1)")
    return read.select(topic.alias("source"), "line", F.md5("value").alias("line_md5"))


# ---------------------------------------------------------------- projections and filters


@query
def select_alias(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "source", "n_chars")
    return docs.select(
        F.col("doc_id").cast("string").alias("ID"), F.col("source").alias("topic"), "n_chars"
    )


@query
def constant_column(spark, folder):
    ids = table(spark, folder, "documents", "doc_id")
    known = table(spark, folder, "labels", "doc_id")
    labelled = ids.join(known, "doc_id", "left_semi").withColumn("groundTruth", F.lit(1.0))
    free = ids.join(known, "doc_id", "left_anti").withColumn(
        "groundTruth", F.lit(S.UNLABELED_WEIGHT)
    )
    return labelled.unionByName(free)


@query
def rename_drop(spark, folder):
    return table(spark, folder, "labels").withColumnRenamed("quality", "label").drop("toxic")


@query
def equality_filter(spark, folder):
    return quality(spark, folder).where(F.col("label") == 0)


@query
def neq_filter(spark, folder):
    return table(spark, folder, "documents", "doc_id", "lang").where(F.col("lang") != "en")


def _source_index(spark, folder) -> DataFrame:
    ids = table(spark, folder, "documents", "source", "doc_id")
    return labels.topic_instance_index(ids, "source", "doc_id").select("source", "doc_id", "ind")


@query
def range_filter(spark, folder):
    return _source_index(spark, folder).where(splits.in_window("ind", *S.WINDOW))


@query
def or_filter(spark, folder):
    return _source_index(spark, folder).where(splits.outside_window("ind", *S.WINDOW))


@query
def hide_labels(spark, folder):
    return splits.hide_labels(quality(spark, folder))


@query
def one_hot_long(spark, folder):
    rows = quality(spark, folder)
    k = labels.class_count(rows).first()["n_classes"]
    encoded = rows.selectExpr("doc_id", f"{vectors.one_hot('label', k)} AS weight")
    return vectors.vector_entries(encoded, "weight", "doc_id").select(
        "doc_id", F.col("bucket").alias("cls"), F.col("value").alias("weight")
    )


# ---------------------------------------------------------------- text


@query
def regex_tokens_query(spark, folder):
    docs = documents(spark, folder, "doc_id", "text").selectExpr("doc_id", f"{regex_tokens('text')} AS w")
    return docs.select("doc_id", F.size("w").alias("n_tokens"), words_md5("w").alias("words_md5"))


@query
def space_tokens_query(spark, folder):
    docs = documents(spark, folder, "doc_id", "text").selectExpr("doc_id", f"{space_tokens('text')} AS w")
    return docs.select(
        "doc_id",
        F.size("w").alias("n_tokens"),
        F.size(F.filter("w", lambda t: t == "")).alias("n_empty"),
        words_md5("w", "|").alias("words_md5"),
    )


def _turn_tokens(spark, folder) -> DataFrame:
    turns = table(spark, folder, "conversations", "conv_id", "turn", "text")
    return turns.selectExpr("conv_id", "turn", f"{regex_tokens('text')} AS words")


@query
def flatten_turns(spark, folder):
    docs = aggregates.lines_to_documents(_turn_tokens(spark, folder), "conv_id", "turn", "words")
    return docs.select("conv_id", F.size("words").alias("n_words"), words_md5("words").alias("words_md5"))


@query
def flatten_lines(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    per_line = f"transform(split(text, '\\n'), line -> {regex_tokens('line')})"
    flat = docs.selectExpr("doc_id", f"{flat_tokens(per_line)} AS w")
    return flat.select("doc_id", F.size("w").alias("n_words"), words_md5("w").alias("words_md5"))


@query
def document_terms(spark, folder):
    return aggregates.document_terms(_turn_tokens(spark, folder), "conv_id", "words")


@query
def document_counts(spark, folder):
    lines = with_hashed_counts(_turn_tokens(spark, folder), "words", S.N_FEATURES, keep=("conv_id",))
    return explode_counts(aggregates.document_counts(lines, "conv_id"), "conv_id")


@query
def stopword_removal(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    kept = docs.selectExpr("doc_id", f"{without_stop_words(regex_tokens('text'))} AS w")
    return kept.select("doc_id", F.size("w").alias("n_kept"), words_md5("w").alias("words_md5"))


@query
def hashed_tf(spark, folder):
    return explode_counts(counted(documents(spark, folder, "doc_id", "text")), "doc_id")


@query
def hashed_tf_java(spark, folder):
    docs = documents(spark, folder, "doc_id", "text")
    rows = with_hashed_counts(docs, regex_tokens("text"), S.N_FEATURES, "java", keep=("doc_id",))
    return explode_counts(rows, "doc_id")


@query
def doc_length(spark, folder):
    return counted(documents(spark, folder, "doc_id", "text")).select("doc_id", "n_terms")


@query
def length_normalised_tf(spark, folder):
    rows = counted(documents(spark, folder, "doc_id", "text"))
    long = explode_counts(rows, "doc_id", "n_terms")
    value = f"tf * {vectors.length_multiplier('n_terms')}"
    return long.selectExpr("doc_id", "bucket", f"round({value}, 6) AS value")


@query
def feature_validation(spark, folder):
    vecs = vectors.vector_entries(
        table(spark, folder, "embeddings", "vec_id", "embedding"), "embedding", "vec_id"
    )
    values = {
        "embeddings": vecs.select(F.col("value").cast("double")),
        "term_counts": explode_counts(
            counted(documents(spark, folder, "doc_id", "text")), "doc_id"
        ).select(F.col("tf").cast("double").alias("value")),
    }
    parts = [
        bayes.feature_violations(rows, "value", kind).select(
            F.lit(name).alias("input"), F.lit(kind).alias("model_type"), "n_values", "n_rejected"
        )
        for name, rows in values.items()
        for kind in bayes.MODEL_TYPES
    ]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- labels and indexes


@query
def label_index_fit(spark, folder):
    parts = [
        labels.fit_label_index(table(spark, folder, name), column).select(
            F.lit(column).alias("column"), "value", "n", "label"
        )
        for name, column in (("documents", "lang"), ("documents", "source"), ("events", "event_type"))
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def label_index_apply(spark, folder):
    ids = table(spark, folder, "documents", "doc_id", "source")
    known = ids.join(table(spark, folder, "labels", "doc_id"), "doc_id", "left_semi")
    codes = labels.fit_label_index(known, "source")
    return labels.apply_label_index(ids, codes, "source", unseen="keep").select("doc_id", "label")


@query
def topic_instance_index(spark, folder):
    turns = labels.topic_instance_index(table(spark, folder, "conversations"), "role", "conv_id")
    docs = labels.topic_instance_index(table(spark, folder, "documents"), "source", "doc_id")
    return turns.select(
        F.lit("conversations").alias("input"), F.col("role").alias("topic"),
        F.col("conv_id").alias("id"), "n", "ind",
    ).unionByName(
        docs.select(
            F.lit("documents").alias("input"), F.col("source").alias("topic"),
            F.col("doc_id").alias("id"), "n", "ind",
        )
    )


@query
def train_topics_only(spark, folder):
    ids = table(spark, folder, "documents", "doc_id", "source")
    train, test = splits.hash_split(ids, "doc_id", [9, 1], S.SEED)
    return labels.with_instance_index(test, "source", "doc_id", topics=train)


@query
def topic_profile(spark, folder):
    turns = table(spark, folder, "conversations", "role", "conv_id")
    return labels.topic_profile(labels.with_instance_index(turns, "role", "conv_id"), "role", "conv_id")


@query
def distinct_topics(spark, folder):
    return labels.distinct_topics(
        table(spark, folder, "documents").select(F.col("source").alias("topic")), "topic"
    )


@query
def class_count(spark, folder):
    ids = table(spark, folder, "documents", "doc_id", "lang")
    return labels.class_count(labels.apply_label_index(ids, labels.fit_label_index(ids, "lang"), "lang"))


@query
def min_class_bound(spark, folder):
    return labels.smallest_class(_source_index(spark, folder), "source")


@query
def newsgroup_corpus(spark, folder):
    """The preparation chain: tokens, topic index from train, both sets to Parquet and back."""
    docs = documents(spark, folder, "doc_id", "source", "text")
    messages = docs.selectExpr(
        "doc_id", "CAST(doc_id AS STRING) AS ID", "source AS topic", f"{regex_tokens('text')} AS words"
    )
    train, test = splits.hash_split(messages, "doc_id", [9, 1], S.SEED)
    train, test = newsgroups.index_messages(train.drop("doc_id"), test.drop("doc_id"))
    paths = [scratch_path(spark, "train"), scratch_path(spark, "test")]
    newsgroups.write_messages(train, test, *paths, train_files=20, test_files=4)
    parts = [
        corpus.read_corpus(spark, path).select(
            F.lit(i).alias("side"), "topic", "ID", "ind", F.size("words").alias("n_words")
        )
        for i, path in enumerate(paths)
    ]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- splits


@query
def hash_split(spark, folder):
    ids = table(spark, folder, "documents", "doc_id")
    return splits.with_hash_side(ids, "doc_id", [7, 2, 1], S.SEED)


@query
def balanced_window_split(spark, folder):
    rows = _source_index(spark, folder).withColumn("label", F.col("source"))
    labelled, unlabelled = splits.balanced_split(rows, *S.WINDOW)
    return labelled.unionByName(unlabelled, allowMissingColumns=True)


@query
def stratified_split(spark, folder):
    ids = table(spark, folder, "documents", "doc_id", F.col("lang").alias("label"))
    sides = splits.stratified_split(ids, "doc_id", "label", [1, 3], S.SEED)
    return reduce(
        DataFrame.unionByName, [s.withColumn("side", F.lit(i)) for i, s in enumerate(sides)]
    )


@query
def size_sweep(spark, folder):
    ids = table(spark, folder, "documents", "doc_id")
    return splits.size_sweep(ids, "doc_id", S.SWEEP_SIZES, S.SWEEP_BASE, S.SEED)


@query
def random_split(spark, folder):
    """Sides are random; that every row is on exactly one of them is not."""
    ids = table(spark, folder, "documents", "doc_id")
    sides = reduce(DataFrame.unionByName, splits.random_split(ids, [9, 1], S.SEED))
    return ids.join(sides.groupBy("doc_id").agg(F.count("*").alias("n_sides")), "doc_id", "left")


@query
def sample_strata(spark, folder):
    sided = splits.with_strata_side(
        quality(spark, folder), "doc_id", "label", S.STRATA_FRACTIONS, S.SEED
    )
    return sided.select("doc_id", "label", "side")


# ---------------------------------------------------------------- sets and aggregates


@query
def union_all(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "lang", "source")
    return docs.unionByName(docs.join(table(spark, folder, "labels", "doc_id"), "doc_id", "left_semi"))


@query
def first_documents(spark, folder):
    docs = table(spark, folder, "documents", "doc_id", "lang", "source", "n_chars")
    return aggregates.preview(docs, F.desc("n_chars"), F.asc("doc_id"))


@query
def row_counts(spark, folder):
    joined = table(spark, folder, "documents", "doc_id").join(quality(spark, folder), "doc_id", "left")
    counts = joined.agg(
        F.count("*").alias("documents"),
        F.count("label").alias("labelled"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
    )
    return counts.unpivot([], ["documents", "labelled", "unlabelled"], "input", "n")


@query
def conditional_counts(spark, folder):
    counts = aggregates.label_counts(quality(spark, folder))
    return counts.withColumn("ratio", F.round("ratio", 6))


@query
def class_mass(spark, folder):
    cells = bayes.class_cells(labelled_counts(spark, folder), PARAMS)
    return cells.where(F.col("bucket") >= 0).select(
        "label", "bucket", F.round("mass", 6).alias("mass"), "df"
    )


@query
def sorted_class_sums(spark, folder):
    prior = bayes.fit(labelled_counts(spark, folder), PARAMS).prior
    return prior.select("label", "n_rows", F.round("mass", 6).alias("mass")).orderBy("label")


# ---------------------------------------------------------------- models


@query
def nb_prior(spark, folder):
    prior = bayes.fit(labelled_counts(spark, folder), PARAMS).prior
    return prior.select(
        "label", "n", "seen", F.round("pi", 6).alias("pi"), F.round("log_denom", 6).alias("log_denom")
    )


@query
def nb_theta(spark, folder):
    full = bayes.full_theta(bayes.fit(labelled_counts(spark, folder), PARAMS).frozen())
    return full.select("label", "bucket", F.round("log_theta", 6).alias("log_theta"))


def _bernoulli(rows: DataFrame) -> tuple[DataFrame, bayes.Params]:
    params = bayes.Params(S.N_FEATURES, S.SMOOTHING, "bernoulli")
    return rows.withColumn("counts", F.transform("counts", lambda x: F.lit(1))), params


@query
def nb_theta_bernoulli(spark, folder):
    rows, params = _bernoulli(labelled_counts(spark, folder))
    model = bayes.fit(rows, params).frozen()
    return bayes.full_theta(model).join(model.prior.select("label", "pi"), "label").select(
        "label", "bucket", F.round("log_theta", 6).alias("log_theta"), F.round("pi", 6).alias("pi")
    )


def _quality_model(spark, folder) -> bayes.Model:
    return bayes.fit(labelled_counts(spark, folder), PARAMS)


def _scored(spark, folder) -> DataFrame:
    rows = counted(documents(spark, folder, "doc_id", "text"))
    return scoring.transform(rows, _quality_model(spark, folder))


@query
def nb_score(spark, folder):
    long = scoring.class_scores(_scored(spark, folder), [0, 1], "doc_id")
    return long.select("doc_id", "label", F.round("raw", 4).alias("raw"))


@query
def nb_posterior(spark, folder):
    long = scoring.class_scores(_scored(spark, folder), [0, 1], "doc_id")
    return long.select("doc_id", "label", F.round("posterior", 6).alias("posterior"))


@query
def nb_predict(spark, folder):
    rows = counted(documents(spark, folder, "doc_id", "text"))
    done = scoring.transform(rows, _quality_model(spark, folder), keep_scores=False)
    return done.select("doc_id", "prediction")


@query
def nb_predict_joined(spark, folder):
    """The same predictions by the shuffle join that models above the size limit use."""
    rows = counted(documents(spark, folder, "doc_id", "text"))
    done = scoring.transform(rows, _quality_model(spark, folder), way="joined", keep_scores=False)
    return done.select("doc_id", "prediction")


@query
def nb_predict_bernoulli(spark, folder):
    train, params = _bernoulli(labelled_counts(spark, folder))
    rows = counted(documents(spark, folder, "doc_id", "text"))
    done = scoring.transform(rows, bayes.fit(train, params), keep_scores=False)
    return done.select("doc_id", "prediction")


@query
def prediction_certainty(spark, folder):
    ranked = vectors.certainty("posterior")
    positional = vectors.certainty("posterior", positional=True)
    return _scored(spark, folder).selectExpr(
        "doc_id", f"round({ranked}, 6) AS certainty", f"round({positional}, 6) AS certainty_positional"
    )


@query
def model_log_prob(spark, folder):
    value = likelihood.model_log_prob(_quality_model(spark, folder).frozen())
    return value.select(F.round("model_log_prob", 4).alias("model_log_prob"))


@query
def data_log_prob(spark, folder):
    value = likelihood.data_log_prob(_quality_model(spark, folder).frozen())
    return value.select(F.round("data_log_prob", 4).alias("data_log_prob"))


@query
def dirichlet_prior(spark, folder):
    value = likelihood.dirichlet_log2_prior(_quality_model(spark, folder).frozen(), S.DIRICHLET_ALPHA)
    return value.select("label", F.round("dirichlet_log2", 4).alias("dirichlet_log2"))


@query
def log_gamma_values(spark, folder):
    """Log-gamma of small, large and negative numbers."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_quantity AS DOUBLE) / 7 AS x", "CAST(l_extendedprice AS DOUBLE) AS y"
    )
    return lines.selectExpr(
        "l_orderkey", "l_linenumber",
        f"round({log_gamma('x')}, 6) AS small", f"round({log_gamma('y')} / y, 6) AS large", f"round({log_gamma('-x - 0.25D')}, 6) AS negative",
    )


@query
def dirichlet_by_feature(spark, folder):
    """Dirichlet density with a parameter for every feature, and for every class and feature."""
    model = _quality_model(spark, folder).frozen()
    by_feature = spark.range(S.N_FEATURES).selectExpr("CAST(id AS INT) AS bucket", "0.25D + (id % 4) * 0.5D AS alpha")
    both = by_feature.selectExpr("bucket", "alpha", "explode(array(0, 1)) AS label").selectExpr("bucket", "label", "alpha + label AS alpha")
    parts = [
        likelihood.dirichlet_log2_prior_by_feature(model, alpha).select(
            F.lit(name).alias("alphas"), "label", F.round("dirichlet_log2", 4).alias("dirichlet_log2")
        )
        for name, alpha in (("feature", by_feature), ("class and feature", both))
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def saved_classifier(spark, folder):
    """Language of every document, by a classifier that was fitted, written and read again."""
    docs = documents(spark, folder, "doc_id", "text", "lang")
    settings = classifier.Settings(label="lang")
    train = docs.where(~held_back())
    path = scratch_path(spark, "classifier")
    classifier.TextClassifier.fit(train, PARAMS, settings).save(path)
    done = classifier.TextClassifier.load(spark, path).transform(docs.drop("lang"))
    return done.select("doc_id", "prediction")


@query
def em_resumed(spark, folder):
    """EM that ends after one epoch and goes on from its journal."""
    journal = scratch_path(spark, "journal")
    settings = em.EMParams(max_epoch=S.EPOCHS, min_improvement=S.MIN_IMPROVEMENT)
    with em.prepared(em_corpus(spark, folder), PARAMS) as rows:
        em.run_em(rows, PARAMS, settings, cache=False, journal=journal, stop_after=1)
        trace = em.run_em(rows, PARAMS, settings, cache=False, journal=journal).trace
    return _rounded_trace(trace)


# ---------------------------------------------------------------- expectation maximisation


def _supervised(rows: DataFrame) -> bayes.Model:
    known = rows.where((F.col("part") == "train") & (F.size("known") > 0))
    return bayes.fit(known.drop("part", "known"), PARAMS)


@query
def em_step(spark, folder):
    with em.prepared(em_corpus(spark, folder), PARAMS) as rows:
        model = em.em_step(rows.where(F.col("part") == "train"), _supervised(rows)).frozen()
    return model.theta.join(model.prior.select("label", "n"), "label").select(
        "label", "n", "bucket", F.round("mass", 6).alias("mass"), "df"
    )


@query
def pseudo_labels(spark, folder):
    rows = em_corpus(spark, folder)
    free = rows.where((F.col("part") == "train") & (F.size("known") == 0)).drop("part", "known")
    done = em.pseudo_labelled(free, _supervised(rows), S.UNLABELED_WEIGHT)
    return done.select(
        "doc_id", "label", F.round(F.get("weight", F.lit(1)), 6).alias("weight1"), "groundTruth"
    )


def _rounded_trace(trace: DataFrame) -> DataFrame:
    return trace.select(
        "epoch",
        *[F.round(c, 6).alias(c) for c in ("acc_test", "acc_train", "ratio")],
        "n_label0", "n_label1",
        *[F.round(c, 4).alias(c) for c in ("model_log_prob", "data_log_prob", "log_prob")],
        F.round("improvement", 9).alias("improvement"),
    )


@query
def em_trace(spark, folder):
    result = em.run_em(em_corpus(spark, folder), PARAMS, em.EMParams(max_epoch=S.EPOCHS))
    return _rounded_trace(result.trace)


@query
def relative_change(spark, folder):
    trace = em.run_em(em_corpus(spark, folder), PARAMS, em.EMParams(max_epoch=S.EPOCHS)).trace
    return likelihood.with_relative_change(trace.drop("improvement")).select(
        "epoch", F.round("improvement", 9).alias("improvement")
    )


@query
def em_loop(spark, folder):
    em_params = em.EMParams(max_epoch=S.EPOCHS, min_improvement=S.MIN_IMPROVEMENT)
    with em.prepared(em_corpus(spark, folder), PARAMS) as rows:
        result = em.run_em(rows, PARAMS, em_params, cache=False)
        # the kept rows are all documents, counted already
        done = scoring.transform(rows, result.model, keep_scores=False).select(
            "doc_id", "prediction", F.lit(result.epochs[0]).alias("epochs")
        )
        return durable(done, "predicted")


@query
def em_weighting(spark, folder):
    parts, first = [], None
    with em.prepared(em_corpus(spark, folder), PARAMS) as rows:
        for weighting in em.WEIGHTINGS:
            em_params = em.EMParams(
                max_epoch=S.EPOCHS, weighting=weighting, unlabeled_weight=S.UNLABELED_WEIGHT
            )
            result = em.run_em(rows, PARAMS, em_params, cache=False, supervised=first)
            first = result.supervised
            trace = _rounded_trace(result.trace)
            parts.append(trace.select(F.lit(weighting).alias("weighting"), "*"))
    return reduce(DataFrame.unionByName, parts)


@query
def supervised_baseline(spark, folder):
    rows = em_corpus(spark, folder)
    test = rows.where(F.col("part") == "test").drop("part", "known")
    done = scoring.transform(test, _supervised(rows), keep_scores=False)
    return evaluate.accuracy(done).withColumn("accuracy", F.round("accuracy", 6))


@query
def all_labels_bound(spark, folder):
    train, test = language_sets(spark, folder)
    done = scoring.transform(test, bayes.fit(train, PARAMS), keep_scores=False)
    return evaluate.accuracy(done).withColumn("accuracy", F.round("accuracy", 6))


@query
def normalised_vs_stock(spark, folder):
    train, test = language_sets(spark, folder)
    min_class = labels.smallest_class(train).first()["min_class"]
    cells = trials.balanced_grid(min_class, S.COMPARE_SIZES, 1, S.SEED)
    stock = bayes.Params(S.N_FEATURES, S.SMOOTHING, normalise=False)
    result = trials.compare_on_samples(train, test, {"normalised": PARAMS, "stock": stock}, cells)
    return result.select("variant", "n_sup", "n_rows", F.round("accuracy", 6).alias("accuracy"))


# ---------------------------------------------------------------- evaluation


@query
def accuracy(spark, folder):
    rows = labelled_counts(spark, folder)
    done = scoring.transform(rows, _quality_model(spark, folder), keep_scores=False)
    return evaluate.accuracy(done).withColumn("accuracy", F.round("accuracy", 6))


@query
def corpus_summary(spark, folder):
    ids = table(spark, folder, "documents", "doc_id")
    joined = ids.join(quality(spark, folder), "doc_id", "left")
    return evaluate.corpus_summary(joined).withColumn("ratio", F.round("ratio", 6))


def _grid(spark, folder) -> DataFrame:
    train, test = language_sets(spark, folder)
    grid, _ = trials.trial_grid(
        train, test, PARAMS, S.GRID_SIZES, S.GRID_TRIALS, S.SEED, em.EMParams(max_epoch=S.GRID_EPOCHS)
    )
    return grid


@query
def trial_grid(spark, folder):
    return _grid(spark, folder).select(
        "n_sup", "trial", "start", "n_rows",
        F.round("acc_sup", 6).alias("acc_sup"), F.round("acc_em", 6).alias("acc_em"),
    )


@query
def trial_grid_joined(spark, folder):
    """The same grid with the models in tables and the weights of all runs in one join."""
    train, test = language_sets(spark, folder)
    em_params = em.EMParams(max_epoch=S.GRID_EPOCHS, way="joined")
    grid, _ = trials.trial_grid(train, test, PARAMS, S.GRID_SIZES, S.GRID_TRIALS, S.SEED, em_params)
    return _rounded(grid, "n_sup", "trial", "start", "n_rows")


@query
def trial_summary(spark, folder):
    summary = evaluate.trial_summary(_grid(spark, folder), "n_sup")
    return summary.select(
        "n_sup", "n_trials",
        *[F.round(c, 6).alias(c) for c in ("mean_sup", "sd_sup", "mean_em", "sd_em")],
    )


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Accuracies, means and deviations to 6 places, behind the columns to keep."""
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in df.columns if c.startswith(("acc_", "mean_", "sd_"))])


def _random_grid(spark, folder) -> DataFrame:
    train, test = language_sets(spark, folder)
    grid, _ = trials.random_grid(
        train, test, PARAMS, S.RANDOM_SIZES, S.RANDOM_TRIALS, S.SEED, em.EMParams(max_epoch=S.GRID_EPOCHS)
    )
    return grid


@query
def random_size_grid(spark, folder):
    return _rounded(_random_grid(spark, folder), "n_sup", "trial", "n_labelled", "n_label0", "n_rows")


@query
def random_size_summary(spark, folder):
    return _rounded(evaluate.trial_summary(_random_grid(spark, folder), "n_sup"), "n_sup", "n_trials")


@query
def sample_bounds(spark, folder):
    """Last row of every random sample of the documents."""
    ids = table(spark, folder, "documents", "doc_id")
    found = sampling.nth_least(ids, "doc_id", S.RANDOM_SIZES, range(1, S.RANDOM_TRIALS + 1), S.SEED)
    return found.select("trial", "size", "hash", F.col("id").alias("doc_id"))


def _weighted_grid(spark, folder) -> DataFrame:
    train, test = language_sets(spark, folder)
    em_params = em.EMParams(max_epoch=S.GRID_EPOCHS, weighting="row")
    grid, _ = trials.weighted_grid(train, test, PARAMS, S.GRID_SIZES, S.GRID_TRIALS, S.SEED, em_params)
    return grid


@query
def weighted_grid(spark, folder):
    """EM with full and with reduced weight of the unlabelled rows, in every cell."""
    return _rounded(_weighted_grid(spark, folder), "n_sup", "trial", "start", "n_rows")


@query
def weighted_summary(spark, folder):
    return _rounded(evaluate.trial_summary(_weighted_grid(spark, folder), "n_sup"), "n_sup", "n_trials")


def _share_trials(spark, folder) -> DataFrame:
    done, _ = trials.share_trials(
        partly_labelled(spark, folder), PARAMS, S.LABEL_SHARES, S.SHARE_TRIALS, S.SEED, em.EMParams(max_epoch=S.GRID_EPOCHS)
    )
    return done


@query
def share_trials(spark, folder):
    return _rounded(_share_trials(spark, folder), "share", "trial", "n_labelled", "n_label0", "n_unlabelled", "n_rows")


@query
def share_summary(spark, folder):
    return _rounded(evaluate.trial_summary(_share_trials(spark, folder), "share"), "share", "n_trials")


@query
def labelled_share_sweep(spark, folder):
    rows = em_corpus(spark, folder)
    return trials.share_sweep(
        rows, PARAMS, S.LABEL_SHARES, 0.1, S.SEED, em.EMParams(max_epoch=S.GRID_EPOCHS)
    ).select(
        "share", "n_rows", F.round("acc_sup", 6).alias("acc_sup"), F.round("acc_em", 6).alias("acc_em")
    )


# ---------------------------------------------------------------- pyspark.ml


@query
def ml_pipeline(spark, folder):
    docs = documents(spark, folder, "doc_id", "text", "lang")
    words = docs.selectExpr("doc_id", "lang AS topic", f"{regex_tokens('text')} AS words")
    train, test = splits.hash_split(words, "doc_id", [9, 1], S.SEED)
    features = pipeline.fit_features(train, S.N_FEATURES)
    train, test = features.transform(train), features.transform(test)
    done = pipeline.fit_normalised(train, S.SMOOTHING).transform(test)
    # the long form fed with the same sparse vectors has to predict the same class
    model = bayes.fit(pipeline.sparse_counts(train), PARAMS)
    rows = pipeline.sparse_counts(done.withColumnRenamed("prediction", "ml"), "ml")
    both = scoring.transform(rows, model, keep_scores=False)
    return both.select(
        "doc_id", "label", "n_terms", (F.col("ml").cast("int") == F.col("prediction")).cast("int").alias("same")
    )


for _name in ("regex_tokens", "space_tokens"):
    QUERIES[_name] = QUERIES.pop(f"{_name}_query")
