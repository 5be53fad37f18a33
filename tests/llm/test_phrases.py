"""Phrase mining: the filter itself, and whole tables against a brute-force version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from labelspring.llm import phrase_filters as pf

SCHEMA = "doc_id long, text string, lang string"


@pytest.mark.parametrize("n", [2, 3, 4])
def test_permutation_is_invertible_and_spread(n):
    rng = np.random.default_rng(n)
    columns = [np.concatenate([np.arange(1, 2001), rng.integers(0, 1 << 32, 2000), [0, (1 << 32) - 1]]).astype(np.uint32) for _ in range(n)]
    q, r = pf.permuted(columns)
    for a, b in zip(pf.restored(q, r, n), columns):
        assert np.array_equal(a, b.astype(np.uint64))
    assert len(set(zip(q.tolist(), r.tolist()))) == len(set(zip(*(c.tolist() for c in columns))))
    # consecutive ids fall evenly on the leading bits
    top = np.bincount((q[:2000] >> np.uint64(16 * n - 3)).astype(int), minlength=8)
    assert top.min() > 150


@pytest.mark.parametrize("n", [2, 3, 4])
def test_filters_count_and_merge_exactly(n):
    rng = np.random.default_rng(7)
    keys = rng.integers(1, 6, (4000, n)).astype(np.uint32)
    keys[:700] = keys[0]  # a counter of more than a byte
    parts = [keys[i : i + 900] for i in range(0, 4000, 900)]
    held = pf.QuotientFilter(n)
    for p in parts:
        held = held.merge(pf.QuotientFilter.of(*pf.permuted([p[:, i] for i in range(n)]), n))
    want = Counter(map(tuple, keys.tolist()))
    ids = pf.restored(held.quotient, held.remainder, n)
    assert dict(zip(zip(*(c.tolist() for c in ids)), held.counts.tolist())) == dict(want)
    pairs = list(zip(held.quotient.tolist(), held.remainder.tolist()))
    assert pairs == sorted(pairs) and len(held.large) == (held.counts > 255).sum() > 0


def test_words_of_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(pf, "SLICE", 16)
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("aB \t.\né") for _ in range(rng.randrange(120)))
        codes = pf._Codes()
        found = np.concatenate([*pf.word_codes(text.encode(), codes), np.zeros(0, np.uint32)])
        names = {v: k for k, v in codes.items()}
        got = [[]]
        for c in found.tolist():
            if c:
                got[-1].append(names[c].decode())
            else:
                got.append([])
        low = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        assert got == [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", low)]


def brute(rows, least, percent, top):
    counts, totals = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    found = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    covered = set()
    for (lang, p), f in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inner = (lang, p[i : i + m])
                if 100 * f >= percent * counts[inner]:
                    covered.add(inner)
    out = {}
    for (lang, p), a in found.items():
        if (lang, p) in covered:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    rows = []
    for lang, phrases in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(phrases)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(rows)


def table(seed, docs=60, words=12, length=80):
    rng = random.Random(seed)
    names = [rng.choice("abcdéÀß") * rng.randrange(1, 4) + str(i) for i in range(words)]
    rows = []
    for i in range(docs):
        text = ""
        while len(text) < length:
            text += rng.choice(names[: rng.randrange(1, words + 1)]).upper() if rng.random() < 0.2 else rng.choice(names)
            text += rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " big red house ", ","])
        rows.append((i, text, rng.choice(["en", "de", None])))
    return rows + [(None, "big red house", "en"), (90, None, "en"), (91, "", None), (91, "", None)] + rows[:20]


@pytest.mark.parametrize("seed,shard,capacity", [(1, 1 << 20, 1 << 20), (2, 50, 64)])
def test_whole_table_equals_brute_force(spark, seed, shard, capacity):
    rows = table(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least, percent, top in ((4, 80, 2000), (3, 50, 7)):
        got = sorted(tuple(r) for r in pf.phrases_by_score(docs, least, percent, top, shard, capacity).collect())
        assert got == brute(rows, least, percent, top)
    assert len(got) > 3


def test_decimal_scores_pass_64_bits(spark):
    words = spark.createDataFrame([("en", "a", 9_000_000_000_000_000_000 // 2, 1), ("en", "b", 4_000_000_000_000_000_000, 2)], "lang string, word string, f long, id long")
    phrases = spark.createDataFrame([(1, 2, 0, 0, 3_999_999_999_999_999_999)], "w1 long, w2 long, w3 long, w4 long, f long")
    row = pf.scored(phrases, words).first()
    assert row.score == 2_000_000 * 3_999_999_999_999_999_999 // (row.l + row.r)


def test_empty_table_and_extra_columns(spark):
    assert pf.phrases_by_score(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(i, "x y. x y", None, "z", 1) for i in range(20)], SCHEMA + ", words string, shard int")
    got = [tuple(r) for r in pf.phrases_by_score(rows).collect()]
    assert got == [("und", 1, "x y", 40, 40, 40, 80, 1_000_000)]
