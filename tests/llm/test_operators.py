"""Operators of the package against brute-force versions, on odd rows and on given tables."""

import functools
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelspring.llm import (
    arrow_tokens,
    bpe,
    decontaminate,
    digest_index,
    induced_sort,
    line_diff,
    packing,
    pii_spans,
    prefix_tokens,
    setsketch,
    substrings,
    toxicity,
    words,
)

SMALL = "/root/testdata/sf0.001"
rng = random.Random(11)
WORDS = [f"w{i}" for i in range(400)] + ["é", "中文", "A1", "x.y"]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(300)
SHARED = prose(90)
ODD = [
    (1, BASE), (2, BASE.replace(" ", "\t \n", 3)), (3, BASE + " tail"), (4, ""), (5, None), (6, "  \n"), (7, "one"),
    (8, "one two"), (9, SHARED + "\n" + prose(40)), (10, prose(30) + "\n" + SHARED), (11, "ab" * 500), (12, prose(9000)),
    (13, "a@b.c tel +1 (555) 123-4567 card 4111 1111 1111 1111 ip 10.0.0.1 or 999.1.1.1"), (14, "stop  words\tand,\rmore"), (3, BASE + " tail"),
    (None, BASE), (None, None), (15, "x" * 1000), (16, "😀 <s> <|endoftext|>  end "), (17, "sure is a trash clown"),
]
COLUMNS = "doc_id long, text string, row string, name string, label string, spans int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "r", "n", None, 1) for i, t in ODD], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def benchmark(spark):
    own = SHARED.split()
    return spark.createDataFrame(
        [(1, " ".join(own[:25])), (2, "one two"), (3, None), (4, ""), (None, "one"), (5, prose(12)), (6, " ".join(own[:10]))],
        "item_id long, text string",
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(1, 10)] + [(None, 1), (3, None)], "doc_id long, toxic int")


def text(t):
    return t or ""


def test_digest_index(odd):
    found = digest_index.decisions(odd).collect()
    keys = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", text(t))) for i, t in ODD]
    groups = defaultdict(list)
    for i, t in keys:
        groups[t].append(i)
    want = Counter()
    for i, t in keys:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        want[(i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(map(tuple, found)) == want
    kept = digest_index.deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len(groups)


def test_digest_index_keeps_one_row_of_an_id_with_other_white_space(spark):
    docs = [(None, "a b"), (None, "a  b"), (None, "a\tb"), (None, "a b"), (7, "c d"), (7, "c  d"), (8, "c d"), (None, "e")]
    kept = digest_index.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, " ".join(r.text.split())) for r in kept) == {(None, "a b"): 1, (7, "c d"): 1, (None, "e"): 1}


def test_digest_index_batches(spark, odd):
    index = digest_index.DigestIndex(spark, buckets=4)
    index.add(odd.where("doc_id <= 8"))
    later = {r.doc_id: r for r in index.add(odd.where("doc_id in (3, 9)")).collect()}
    assert later[3].keep_id == 3 and later[9].keep_id == 9
    moved = spark.createDataFrame([(99, BASE)], "doc_id long, text string")
    assert index.add(moved).first().keep_id == 1
    assert index.table().count() == index.table().select("digest").distinct().count()


def near_brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = text(t).encode().lower().split()
        n = min(size, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, x in enumerate(ids):
        for y in ids[:a]:
            c = len(sets[x] & sets[y])
            if c and 100 * c >= percent * (len(sets[x]) + len(sets[y]) - c):
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, size, percent):
    rows = [(i, t) for i, t in dict(ODD).items() if i is not None]
    for g in range(3):
        base = prose(120).split()
        for k in range(25):
            share = rng.random() * 0.07
            rows.append((100 + 25 * g + k, " ".join(rng.choice(WORDS) if rng.random() < share else w for w in base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(docs, size, percent, hubs=4).collect()}
    assert found == near_brute(rows, size, percent)


def test_near_duplicates_odd_rows(odd, empty):
    found = setsketch.near_duplicates(odd, 3, 85).collect()
    assert len(found) == len(ODD)
    assert {r.component_id for r in found if r.doc_id in (1, 2, 3)} == {1}
    kept = setsketch.deduplicate(odd, 3, 85)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and ids.count(1) == 1 and 2 not in ids and 3 not in ids
    assert setsketch.near_duplicates(empty).count() == 0


def test_setsketch_merges_and_estimates():
    a, b = setsketch.multipliers(400)
    x = words.mix(np.arange(3000, dtype=np.uint64))
    left, right = x[:2000], x[1000:]
    merged = setsketch.merge(setsketch.sketch(left, a, b), setsketch.sketch(right, a, b))
    assert (merged == setsketch.sketch(x, a, b)).all()
    p, q = setsketch.sketch(left, a, b), setsketch.sketch(right, a, b)
    estimate = setsketch.jaccard_estimate((p == q).sum(), (p > q).sum(), (p < q).sum())
    assert abs(estimate - 1 / 3) < 0.1


def test_parities_bound_the_difference(spark):
    universe = words.mix(np.arange(6000, dtype=np.uint64))
    rows, links = [], {}
    for k in range(60):
        base = universe[: rng.choice([1, 3, 40, 300, 3000])]
        other = np.concatenate([base[: len(base) - rng.randrange(len(base) // 8 + 1)], universe[4000 : 4000 + rng.randrange(len(base) // 8 + 2)]])
        pair = [(setsketch.parities(e).tolist(), len(e)) for e in (base, other)]
        rows.append((k, *pair[0], *pair[1]))
        c = len(np.intersect1d(base, other))
        links[k] = 100 * c >= 85 * (len(base) + len(other) - c)
    table = spark.createDataFrame(rows, "k long, a array<long>, n long, b array<long>, m long")
    passed = {r.k for r in table.where(setsketch.may_link("a", "b", "n", "m", 85)).select("k").collect()}
    assert {k for k, linked in links.items() if linked} <= passed
    assert len(passed) < len(rows)


def test_fit_equals_prefix_table():
    counter = prefix_tokens.PieceCounter.shared()
    for t in ["", " ", "a", "  x  y ", "中文 é\u2581z", prose(40), " " + prose(9) + "  "]:
        for budget in (0, 1, 2, 3, 7, 20, 1000):
            assert counter.fit(t, budget) == counter.table(t).fit(budget)


def contamination_brute(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text(t)))
    wins = defaultdict(set)
    for item, t in items:
        w = split(t)
        n = min(10, len(w))
        if item is not None and w:
            for s in range(len(w) - n + 1):
                wins[tuple(w[s : s + n])].add(str(item))
    out = Counter()
    for i, t in rows:
        w = split(t)
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[(i, len(w), len(hit), len(found), digest, bool(hit))] += 1
    return out


def test_contamination(odd, empty, benchmark):
    found = Counter(tuple(r) for r in decontaminate.contamination(odd, benchmark).drop("text_hash").collect())
    assert found == contamination_brute(ODD, [tuple(r) for r in benchmark.collect()])
    kept = decontaminate.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns
    assert kept.count() == sum(n for k, n in found.items() if not k[-1])
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(odd, benchmark.limit(0)).where("contaminated").count() == 0


def test_contamination_by_shuffle_join(odd, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", 0)
    found = Counter(tuple(r) for r in decontaminate.contamination(odd, benchmark).drop("text_hash").collect())
    assert found == contamination_brute(ODD, [tuple(r) for r in benchmark.collect()])


def test_substrings(odd, empty):
    length = 400
    rows = [(i, text(t).encode()) for i, t in ODD]
    counts = Counter(b[s : s + length] for _, b in rows for s in range(len(b) - length + 1))
    want = Counter()
    for i, b in rows:
        spans = []
        for s in range(len(b) - length + 1):
            if counts[b[s : s + length]] > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + length
                else:
                    spans.append([s, s + length])
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        kept += b[at:]
        want[(i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())] += 1
    found = Counter(tuple(r) for r in substrings.remove_repeated(odd).drop("kept").collect())
    assert found == want
    assert substrings.remove_repeated(empty).count() == 0


def cut_brute(docs, length=400):
    rows = [(i, text(t).encode()) for i, t in docs]
    counts = Counter(b[s : s + length] for _, b in rows for s in range(len(b) - length + 1))
    want = Counter()
    for i, b in rows:
        repeated = [s for s in range(len(b) - length + 1) if counts[b[s : s + length]] > 1]
        gone = np.zeros(len(b) + 1, bool)
        for s in repeated:
            gone[s : s + length] = True
        spans = sum(y - x > length for x, y in zip(repeated, repeated[1:])) + bool(repeated)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[(i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    return want


@pytest.mark.parametrize("shard", [40, 1 << 20])
def test_substrings_of_a_hot_passage(spark, monkeypatch, shard):
    """Different blocks of one core beyond the shard are not sorted in one task, equal ones only once."""
    passage, ends = prose(200), [prose(4) for _ in range(6)]
    docs = [(i, f"{prose(60)}{ends[i % 6]}{passage}{ends[i % 5]}{prose(60)}") for i in range(40)]
    seen, plain = [], substrings.divided
    monkeypatch.setattr(substrings, "divided", lambda *a: seen.append(plain(*a)) or seen[-1])
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = Counter(tuple(r) for r in substrings.remove_repeated(frame, shard=shard).drop("kept").collect())
    assert found == cut_brute(docs)
    equal, few, many = seen[0]
    assert equal.count() > 0 and bool(many.count()) == (shard == 40)
    size = F.sum(F.octet_length("before") + F.octet_length("after") + 2)
    for core in few.groupBy("core").agg(F.count("*").alias("n"), F.count_distinct("before", "after").alias("kinds"), size.alias("size")).collect():
        assert core.n == core.kinds and core["size"] <= shard


@pytest.mark.parametrize("held", [3, 10**6])
def test_induced_sorting(held):
    for n in range(150):
        parts = [bytes(rng.choice(b"ab" if n % 2 else b"abcd") for _ in range(rng.randint(0, 16))) for _ in range(rng.randint(1, 5))]
        numbers, _ = induced_sort.join([*parts, parts[0]])
        t = numbers.tolist()
        order = sorted(range(len(t)), key=lambda i: t[i:])
        common = [0] + [len(os.path.commonprefix([t[a:], t[b:]])) for a, b in zip(order, order[1:])]
        assert list(induced_sort.sorted_suffixes(numbers, held)) == list(zip(order, common))


@functools.cache
def library_tokenizer():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path("byte_bpe_50k.json"))


def encoded(t):
    return library_tokenizer().encode(text(t), add_special_tokens=False).ids


def test_packing(odd, empty):
    found = packing.packed(odd, capacity=64).collect()
    total, by_id, by_sequence = 0, defaultdict(list), defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, t in ODD:
        ids = np.array([*encoded(t), 2], dtype="<u4")
        total += len(ids)
        if [x for x, _ in ODD].count(i) > 1:
            continue
        at = 0
        for n, r in enumerate(sorted(by_id[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (n, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in found) == total
    assert len(by_sequence) <= -(-total // 64) + 2
    assert packing.packed(empty).count() == 0


def test_local_search_improves_on_best_fit():
    for _ in range(20):
        lengths = [rng.randint(200, 700) for _ in range(60)]
        bins = packing.Bins(lengths, 1024)
        bins.best_fit()
        before = len(bins.items)
        bins.search()
        assert sorted(i for b in bins.items for i in b) == list(range(60))
        assert all(sum(lengths[i] for i in b) <= 1024 for b in bins.items)
        assert len(bins.items) <= before


def test_token_files(spark, odd, empty, tmp_path):
    rows = arrow_tokens.round_trip(odd, spark).collect()
    assert len(rows) == len(ODD) and arrow_tokens.round_trip(empty, spark).count() == 0
    want = Counter()
    for i, t in ODD:
        ids = np.array([*encoded(t), 0], dtype="<u4")
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])


def test_sequences_are_random_access(tmp_path):
    ids = np.arange(40_000, dtype=np.uint32) % 50_000
    with open(tmp_path / "x", "wb") as f:
        writer = arrow_tokens.SequenceWriter(f, length=64)
        for part in np.array_split(ids, 7):
            writer.add(part)
        writer.close()
    reader = arrow_tokens.SequenceReader(pa.memory_map(str(tmp_path / "x")))
    assert (reader.ids(16_300, 500) == ids[16_300:16_800]).all()
    values, mask = reader.sequence(40_000 // 64)
    assert len(values) == 64 and sum(mask.to_pylist()) == 40_000 % 64 or 40_000 % 64 == 0


def test_token_counts(odd, empty):
    import sentencepiece
    from public_tokenizers import path

    library = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    counter = prefix_tokens.PieceCounter.shared()
    found = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in prefix_tokens.token_counts(odd).collect())
    assert found == Counter((i, len(text(t).encode()), len(library.encode(text(t)))) for i, t in ODD)
    for _, t in ODD:
        table = counter.table(text(t)[:300])
        for end in range(len(table.text) + 1):
            assert table.count_at(end) == len(library.encode(table.text[:end]))
        end = table.fit(20)
        assert table.count_at(end) <= 20
    assert prefix_tokens.token_counts(empty).count() == 0


def test_encoder_cuts_safely():
    letters = list("abcé ñ\n\t 。中😀01.,;'$!_²Ⅷ") + [" ", "  ", " ab", " the.\nIt", " It's", " x$$\n", "!.\nÉa,"]
    encoder = bpe.Encoder.shared()
    for _ in range(20_000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encoder.encode(t), dtype="<u4").tolist() == encoded(t)


def test_personal_data(odd, empty):
    row = next(r for r in pii_spans.personal_data(odd).collect() if r.doc_id == 13)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    t = dict(ODD)[13]
    found = {k: t[int(a) : int(b)] for k, a, b in (x.split(":") for x in row.spans.split(","))}
    assert found == {"email": "a@b.c", "ip": "10.0.0.1", "card": "4111 1111 1111 1111", "phone": "+1 (555) 123-4567"}
    assert pii_spans.personal_data(empty).count() == 0


def test_personal_data_trains_on_different_texts(spark, empty):
    texts = [f"note {i} at 10.0.0.{i}" for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * (pii_spans.DOCS + 1))], "doc_id long, text string")
    assert sorted(pii_spans.training_texts(docs)) == texts
    assert pii_spans.training_texts(empty) == []


def test_personal_data_model_adds_spans():
    texts = [f"{prose(6)} call +{rng.randint(1, 9)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)} now {prose(3)} v{rng.randint(1, 9)}.{rng.randint(0, 9)}" for _ in range(60)]
    model = pii_spans.train(texts)
    _, spans = pii_spans.all_spans("please call 1 (555) 123-4567 now", model)
    assert [s[0] for s in spans] == ["phone"]
    assert pii_spans.all_spans("version 3.0 of 2024", model)[1] == []


def test_lines(odd, empty):
    rows = {r.doc_id: r for r in line_diff.deduplicated(odd).collect()}
    assert rows[9].n_removed == 0 and rows[10].n_removed == 1
    assert rows[10].text == text(dict(ODD)[10]).split("\n")[0]
    assert rows[12].n_removed == 0 and line_diff.deduplicated(empty).count() == 0


def test_removed_lines_are_held_by_earlier_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for i in sorted(texts):
        for line in texts[i].split("\n"):
            first.setdefault(line.strip(), i)
    for r in line_diff.deduplicated(docs).collect():
        lines = texts[r.doc_id].split("\n")
        gone = Counter(lines) - Counter(r.text.split("\n") if r.n_removed < len(lines) else [])
        assert all(first[line.strip()] < r.doc_id or not line.strip() for line in gone)
    copies = {t for t, n in Counter(texts.values()).items() if n > 1}
    emptied = {r.doc_id for r in line_diff.deduplicated(docs).collect() if r.n_removed == r.n_lines}
    for t in copies:
        assert all(i in emptied for i in sorted(i for i, x in texts.items() if x == t)[1:])


def test_lines_of_many_documents_and_many_edits(spark):
    block = lambda name: [f"{name} line {i}" for i in range(5)]
    docs = [(i, "\n".join([f"before {i}", *block(f"p{i}"), f"after {i}"])) for i in range(10)]
    docs.append((20, "\n".join(line for i in range(10) for line in [*block(f"p{i}"), f"own {i}"])))
    body = [f"body {i}" for i in range(55)]
    docs.append((30, "\n".join(body)))
    docs.append((31, "\n".join(f"edit {i}" if i % 5 == 2 else line for i, line in enumerate(body))))
    # a passage that many share, and rarer lines beside it
    docs += [(40, "often one\noften two")] + [(i, f"often one\noften two\nx {i}") for i in range(41, 50)]
    docs += [(50 + i, f"rare {i}") for i in range(6)] + [(60, "\n".join(["often one", "often two", *(f"rare {i}\nown r{i}" for i in range(6))]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r.text for r in line_diff.deduplicated(frame).collect()}
    assert rows[20] == "\n".join(f"own {i}" for i in range(10))
    assert rows[31] == "\n".join(f"edit {i}" for i in range(55) if i % 5 == 2)
    assert rows[49] == "x 49" and rows[60] == "\n".join(f"own r{i}" for i in range(6))
    assert all(rows[i] == t for i, t in docs if i < 20 or i in (30, 40) or 50 <= i < 60)


def test_patience():
    assert line_diff.patience([1, 2, 3, 9, 4], [7, 1, 2, 3, 4]) == [(0, 1), (1, 2), (2, 3), (4, 4)]
    assert line_diff.aligned_blocks([5, 1, 2, 6], [1, 2, 8], {1}) == [1, 2]


def test_toxicity_odd_rows(odd, empty, labels):
    model = toxicity.fit(odd, labels)
    assert toxicity.scores(odd, model).count() == len(ODD)
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    none = toxicity.fit(odd, labels.limit(0))
    assert toxicity.scores(odd, none).where("rejected").count() == 0
    assert toxicity.scores(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_held_out(spark):
    """Fitted on half of the labels; the other half has one-sided label noise."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, known.where("doc_id % 2 = 0"))
    assert (np.diff(model.cuts) > 0).all() and len(model.cuts) == 3
    rest = toxicity.scores(docs, model).join(known.where("doc_id % 2 = 1"), "doc_id")
    counts = {(r.toxic, r.rejected): r["count"] for r in rest.groupBy("toxic", "rejected").count().collect()}
    right = counts.get((1, True), 0) + counts.get((0, False), 0)
    assert right / sum(counts.values()) > 0.95
    assert counts.get((0, True), 0) <= 0.005 * counts[(0, False)]


def test_ordinal_fit_recovers_order():
    random_state = np.random.default_rng(3)
    x = (random_state.random((3000, 4)) < 0.4).astype(float)
    noise = random_state.logistic(size=3000)
    grades = np.digitize(x @ np.array([2.0, 1.0, 0.0, -1.0]) + noise, [0.5, 2.5])
    w, cuts = toxicity.fit_ordinal(x, grades, 2)
    assert np.allclose(w, [2, 1, 0, -1], atol=0.3) and np.allclose(cuts, [0.5, 2.5], atol=0.3)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, SMALL)
        if name != "packing":
            assert kept.columns == docs.columns
            kept = spark.createDataFrame(kept.collect(), docs.schema)
        if name == "exact_dedup":
            assert kept.count() == before.select(F.regexp_replace("text", digest_index.WHITE, " ")).distinct().count()
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {i for i, (_, c) in near_brute(rows, 5, 80).items() if i == c}
            assert {r.doc_id for r in kept.collect()} == want
    assert kept.agg(F.countDistinct("doc_id")).first()[0] == before.count()


def test_stored_prefix_tables(odd):
    """Counts and budgets from the stored table equal those of the library on the prefixes."""
    import sentencepiece
    from public_tokenizers import path

    library = sentencepiece.SentencePieceProcessor(model_file=path(prefix_tokens.MODEL))
    counter = prefix_tokens.PieceCounter.shared()
    texts = defaultdict(list)
    for i, t in ODD:
        texts[i].append(text(t))
    rows = prefix_tokens.prefix_tables(odd).collect()
    assert Counter(r.doc_id for r in rows) == Counter({i: len(t) for i, t in texts.items()})
    for r in rows:
        own = [t for t in texts[r.doc_id] if counter.table(t).sums == list(r.sums)]
        assert own and r.starts[-1] == len(counter._marked(own[0]))
        t = own[0]
        table = prefix_tokens.PrefixTable(counter, t, r.starts, r.sums)
        for end in {0, 1, len(t) // 3, len(t) // 2, len(t)}:
            if end <= len(t) <= 3000:
                assert table.count_at(end) == len(library.encode(t[:end], num_threads=1))
        budget = r.sums[-1] // 2
        end = table.fit(budget)
        assert table.count_at(end) <= budget and (end == len(t) or table.count_at(end + 1) > budget)


def test_new_words_are_learnt_like_single_ones():
    counter = prefix_tokens.PieceCounter(__import__("public_tokenizers").path(prefix_tokens.MODEL))
    words = {"".join(rng.choice("abthein.,é中") for _ in range(rng.randrange(1, 12))) for _ in range(3000)}
    counter.learn(words)
    for w in words:
        assert counter.totals[w] == counter.prefix_counts(prefix_tokens.SPACE + w)[-1]


def test_gaps_without_unique_lines_are_aligned():
    block = [11, 12, 13]
    # each line is twice in the later document: its first occurrence meets the earlier one
    assert line_diff.aligned_blocks([1, *block, 2, *block, 4], [7, *block, 8], set(block)) == [1, 2, 3]
    # nothing in this gap is unique on both sides
    assert line_diff.aligned_blocks([5, 6, 5, 6, 1], [2, 6, 5, 6, 5], {5, 6}) == [1, 2, 3]
    assert line_diff.aligned_blocks([0, 0, 9], [0, 8, 0], {9}) == []


def test_alignment_is_a_common_subsequence():
    for _ in range(300):
        later, earlier = ([rng.randrange(7) for _ in range(rng.randrange(15))] for _ in range(2))
        pairs = line_diff.patience(later, earlier)
        assert all(later[i] == earlier[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        if {x for x in later if x} & set(earlier):
            assert pairs
        gone = line_diff.aligned_blocks(later, earlier, set(earlier) - {0})
        assert gone == sorted(set(gone)) and all(later[i] in earlier for i in gone)
