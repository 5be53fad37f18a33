"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(cut_k - w.x): one weight per term, shared by all grades,
and ordered cuts.  x marks the presence of a term (a 64-bit hash of a lower-cased
word).  The score of a document is its expected grade; it is rejected if a grade
of 1 or more is at least as likely as not.

The model is fitted on a bounded sample: the ``sample`` labelled rows whose id hashes
lowest, reached by a broadcast of so many ids, so no text is shuffled.  Near copies
in the sample count once.  Terms are chosen by their association with the label.
Labels are binary here; the graded form comes from the sample itself: a toxic row
has grade 1, 2 or 3 by the number of chosen terms it holds (GRADE_AT).  ``fit`` takes
any graded column instead.  Scoring reads every row and whole text, in place.

Defined cases: null and empty texts have no terms and get the model's base rate.
Null labels and labels without a document are ignored; a doc_id labelled twice takes
its highest grade.  Without labels of both kinds nothing is rejected.  Repeated rows
get equal scores; other columns are ignored by scores and kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm import words
from labelspring.llm.common import releasing, whole_text

SAMPLE = 8_000  # labelled rows used for fitting
TERMS = 512  # terms with a weight
LEAST_ROWS = 6  # sample rows that hold a term
LEAST_Z = 6.0  # standard deviations between expected and observed toxic rows with a term
PENALTY = 0.5  # L2 penalty on weights
STEPS = 400
GRADE_AT = (2, 4)  # terms from which a toxic row has grade 2 and 3
LIMIT = 0.5  # probability of grade 1 or more from which a document is rejected

OUT_ROWS = 1000  # rows given back at once


@dataclass
class Model:
    terms: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    cuts: np.ndarray = field(default_factory=lambda: np.array([np.inf]))

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k: one column per cut."""
        return _logistic(score[:, None] - self.cuts[None, :])


def _logistic(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in words.slices(batch.column(1)):
            hashes, at = words.word_hashes(data, offsets, words.NOT_ALNUM)
            parts = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(end - first)]
            ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).slice(first, end - first), lists], names=["grade", "terms"]
            )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """grade and distinct terms of at most ``size`` labelled documents."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )
    rows = whole_text(docs).join(F.broadcast(chosen), "doc_id")
    return rows.select("doc_id", "text", "grade").mapInArrow(releasing(_distinct_terms), "grade int, terms array<long>").limit(2 * size)


def select_terms(terms: list[np.ndarray], toxic: np.ndarray, limit: int) -> np.ndarray:
    """Terms found with toxic rows more often than chance explains, strongest first, then sorted."""
    if not terms:
        return np.zeros(0, np.uint64)
    n, p = len(toxic), toxic.mean()
    rows = np.repeat(np.arange(n), [len(t) for t in terms])
    values, inverse, count = np.unique(np.concatenate(terms), return_inverse=True, return_counts=True)
    hits = np.bincount(inverse, weights=toxic[rows], minlength=len(values))
    z = (hits - count * p) / np.sqrt(np.maximum(count * p * (1 - p), 1e-12))
    good = np.flatnonzero((count >= LEAST_ROWS) & (z >= LEAST_Z))
    return np.sort(values[good[np.argsort(-z[good], kind="stable")][:limit]])


def _matrix(terms: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(terms), len(chosen)))
    for i, t in enumerate(terms):
        x[i, np.searchsorted(chosen, np.intersect1d(t, chosen, assume_unique=True))] = 1.0
    return x


def fit_ordinal(x: np.ndarray, grades: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts of the penalised likelihood, by accelerated gradient steps.

    Cuts are the first one plus positive gaps, exp of the free parameters.
    """
    n, d = x.shape
    share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-4, 1 - 1e-4)
    cuts = -np.log(share / (1 - share))
    free = np.concatenate([np.zeros(d), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    moment, square = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, STEPS + 1):
        w, gaps = free[:d], np.exp(free[d + 1 :])
        cut = free[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = x @ w
        # P(grade = g) = F(cut_g - s) - F(cut_{g-1} - s)
        edges = _logistic(np.concatenate([[-np.inf], cut, [np.inf]])[None, :] - score[:, None])
        slope = edges * (1 - edges)
        row = np.arange(n)
        p = np.maximum(edges[row, grades + 1] - edges[row, grades], 1e-12)
        up, down = slope[row, grades + 1] / p, slope[row, grades] / p
        grad_score = down - up  # of the log-likelihood
        grad_cut = np.array([up[grades == k].sum() - down[grades == k + 1].sum() for k in range(top)])
        grad = np.concatenate([
            x.T @ grad_score - PENALTY * w,
            [grad_cut.sum()],
            [grad_cut[k + 1 :].sum() * gaps[k] for k in range(top - 1)],
        ])
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        rate = 0.2 * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
        free = free + rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return free[:d], free[d] + np.concatenate([[0.0], np.cumsum(np.exp(free[d + 1 :]))])


def fit_rows(terms: list[np.ndarray], grades: np.ndarray) -> Model:
    """Fit on rows held in memory (the sample)."""
    seen, rows = set(), []
    for i, t in enumerate(terms):
        # near copies share most of their least hashes
        key = tuple(np.sort(words.mix(t))[:3].tolist())
        if key not in seen or len(t) < 3:
            seen.add(key)
            rows.append(i)
    terms, grades = [terms[i] for i in rows], grades[rows]
    if not len(grades) or grades.min() > 0 or grades.max() <= 0:
        return Model()
    chosen = select_terms(terms, (grades > 0).astype(float), TERMS)
    x = _matrix(terms, chosen)
    if grades.max() == 1:
        held = x.sum(axis=1)
        grades = np.where(grades > 0, 1 + sum((held >= at).astype(int) for at in GRADE_AT), 0)
    _, grades = np.unique(grades, return_inverse=True)
    weights, cuts = fit_ordinal(x, grades, int(grades.max()))
    return Model(chosen, weights, cuts)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    table = labelled_sample(docs, labels, label, sample).toArrow()
    lists = table.column("terms").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    flat = np.asarray(lists.flatten()).view(np.uint64)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))]).astype(int)
    grades = np.asarray(table.column("grade").to_numpy())
    terms = [flat[ends[i] : ends[i + 1]] for i in range(len(grades))]
    order = sorted(range(len(terms)), key=lambda i: (int(grades[i]), terms[i].tobytes()))  # whatever the partitions were
    return fit_rows([terms[i] for i in order], np.maximum(grades[order], 0) if len(order) else np.zeros(0, int))


def linear_scores(texts: pa.Array, model: Model) -> np.ndarray:
    """w.x of every text."""
    out = np.zeros(len(texts))
    if not len(model.terms):
        return out
    near = np.zeros(1 << 16, dtype=bool)
    near[model.terms >> np.uint64(48)] = True
    for first, end, data, offsets in words.slices(texts):
        hashes, at = words.word_hashes(data, offsets, words.NOT_ALNUM)
        maybe = np.flatnonzero(near[hashes >> np.uint64(48)])
        place = np.minimum(np.searchsorted(model.terms, hashes[maybe]), len(model.terms) - 1)
        hit = model.terms[place] == hashes[maybe]
        row = np.searchsorted(at, maybe[hit], "right") - 1
        pairs = np.unique(row * len(model.terms) + place[hit])
        np.add.at(out, first + pairs // len(model.terms), model.weights[pairs % len(model.terms)])
    return out


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_toxic, expected_severity, grade (the likeliest), rejected of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = model.above(linear_scores(batch.column(1), model))
            full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(above[:, 0]), pa.array(above.sum(axis=1)),
                    pa.array((full[:, :-1] - full[:, 1:]).argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= LIMIT),
                ],
                names=["doc_id", "p_toxic", "expected_severity", "grade", "rejected"],
            )

    return whole_text(docs).mapInArrow(releasing(run), "doc_id long, p_toxic double, expected_severity double, grade int, rejected boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not rejected, with all their columns, without moving any."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(first, OUT_ROWS)
                texts = pc.fill_null(part.column(at), "")
                yield part.filter(pa.array(model.above(linear_scores(texts, model))[:, 0] < LIMIT))

    return docs.mapInArrow(releasing(run), docs.schema)
