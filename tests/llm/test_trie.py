"""The conversation trie against a brute-force version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from labelspring.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def symbol(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role.encode(), symbol(role, text), (role, text)))
    turns = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)  # the remainder takes the sign of the id
        built[c] = turns.get(base, [])[:h] + mine[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].add(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def got(df):
    return sorted(tuple(r) for r in df.collect())


def conversations(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 450), convs):
        for turn in range(rng.choice([1, 2, 3, longest])):
            n = rng.choice([None, turn, turn, 1])
            rows.append((c, n, rng.choice(["user", "bot", None]), rng.choice([*words, None, ""])))
    return rows


@pytest.mark.parametrize("seed,convs,longest,words", [(1, 80, 5, ["a", "é漢"]), (2, 40, 19, ["x"]), (3, 120, 3, ["p", "q", "r"])])
def test_whole_table_equals_brute_force(spark, seed, convs, longest, words):
    rows = conversations(seed, convs, longest, words)
    rows += rows[:10] + [(None, 1, "user", "lost"), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(trie.conversation_trie(df)) == brute(rows)


def test_equal_conversations_and_a_long_one(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 16)
    rows = [(c, t, "user", "same") for c in range(300) for t in range(3)]
    rows += [(777, t, "bot", str(t % 3)) for t in range(260)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(trie.conversation_trie(df)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(5, 1, "user", "x")], [(5, 1, None, None), (5, 1, None, None)], [(None, 1, "a", "b")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA + "")
    assert got(trie.conversation_trie(df)) == brute(rows)


def test_extra_columns(spark):
    rows = spark.createDataFrame([(1, 1, "u", "t", 3, "s", 9)], SCHEMA + ", pos int, symbol string, depth int")
    assert got(trie.conversation_trie(rows)) == brute([(1, 1, "u", "t")])


def test_depth_costs_its_logarithm(spark, monkeypatch):
    """A trie of depth 64 takes 6 cuts and 6 to 7 grafts, not 64 rounds."""
    names = []
    kept = trie.written
    monkeypatch.setattr(trie, "written", lambda df, name, *a: names.append(name) or kept(df, name, *a))
    rows = [(1, t, "u", str(t % 2)) for t in range(64)]
    sequences, members = trie.rebuilt(trie.ordered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert trie.prefix_trie(sequences, members).count() == members.first()["length"] + 1
    assert sum(n.startswith("trees_") for n in names) == 6 and sum(n.startswith("totals_") for n in names) <= 7
