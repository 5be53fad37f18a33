"""Prefix trie of conversations by van Emde Boas recursion.

Sequences are rows (conv_id, pos, symbol), so one of any length is spread like any other.

1. *Block names.*  Aligned blocks of 1, 2, 4, ... turns are named by digests, each level from
   the pairs of the one below.
2. *Cuts.*  A tree of height 2h is cut at half its depth: the sequences that reach the cut are
   grouped by (root, name of the block up to the cut), and a cut prefix is named by the
   smallest conversation that has it.  Each name is one sequence of the upper tree, with the
   number of conversations it stands for, and the root of a lower tree for what follows.
   Upper trees and lower forests of one height are all cut in the same Spark job, so a trie
   of depth d takes about log2(d) of them.  Trees of height 1 are the edges: node, parent,
   members.
3. *Grafts.*  For h = 1, 2, 4, ... the totals of lower trees of height h are added to the
   ancestors of their roots in the upper tree above, at most h of them; ancestor pairs double
   with h, and no level holds more pairs than the trie has nodes.

A node is known by its smallest member and its depth.  Group joins spread hot prefixes.

Defined cases: null turns come first; turns with one number are ordered by role, then by digest;
null role or text is empty; rows with a null conv_id belong to no conversation; repeated rows
are turns of their own.  An empty table gives no node.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspring.llm.common import written
from labelspring.operators.joins import join_groups
from labelspring.operators.ranking import rank_within

GROUP = 100  # conversations that share the opening turns of the first of them
HEADS = 6  # they share fewer than this many turns
IDS = 8192  # conversation ids joined to one string

NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth"]


# ---------------------------------------------------------------- sequences


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), symbol (digest of role and text), size (code points of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("symbol"),
        F.char_length(text).cast("long").alias("size"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("symbol")]
    ranked = rank_within(rows, "conv_id", order, "pos")
    return written(ranked.select("conv_id", "pos", F.unhex("symbol").alias("symbol"), "size"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences and (conv_id, length) with the opening turns of the group's first conversation.

    The number of shared turns is the CRC-32 of the decimal id modulo HEADS.
    """
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("long")
    own = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    wanted = own.select("conv_id", "n", shared.alias("h"), base)
    first = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    wanted = wanted.join(first, "base", "left").select(
        "conv_id", "n", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head"),
    )
    wanted = written(wanted.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    opening = turns.where(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base")
    heads = wanted.where("head > 0").select("conv_id", "base", "head").join(opening, "base").where("pos < head")
    rest = turns.where(F.col("pos") >= shared)
    tails = join_groups(rest, wanted.select("conv_id", "h", "head", "n"), ["conv_id"], "n")
    columns = ["conv_id", "pos", "symbol", "size"]
    sequences = heads.select(*columns).unionByName(
        tails.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "symbol", "size")
    )
    return written(sequences, "sequences"), wanted.select("conv_id", "length")


# ---------------------------------------------------------------- cuts


def _blocks(sequences: DataFrame, height: int) -> dict[int, DataFrame]:
    """Names (conv_id, block, name) of the complete aligned blocks of 1, 2, ... height / 2 turns."""
    out, size = {1: sequences.select("conv_id", F.col("pos").alias("block"), F.col("symbol").alias("name"))}, 1
    while 2 * size < height:
        odd = F.col("block") % 2
        pairs = out[size].groupBy("conv_id", F.floor(F.col("block") / 2).alias("block")).agg(
            F.max(F.when(odd == 0, F.col("name"))).alias("left"), F.max(F.when(odd == 1, F.col("name"))).alias("right")
        )
        named = pairs.where("left IS NOT NULL AND right IS NOT NULL").select(
            "conv_id", "block", F.unhex(F.sha2(F.concat("left", "right"), 256)).alias("name")
        )
        size *= 2
        out[size] = written(named, f"blocks_{size}")
    return out


def _cut(trees: DataFrame, blocks: DataFrame, half: int) -> tuple[DataFrame, DataFrame]:
    """Upper and lower trees of height ``half``, and the ends (conv_id, node, depth) met at the cut."""
    reach = trees.where(F.col("length") >= half)
    at = blocks.select("conv_id", (F.col("block") * half).alias("start"), "name")
    keyed = written(reach.join(at, ["conv_id", "start"]), f"reach_{half}")
    key = ["root", "start", "name"]
    groups = written(
        keyed.groupBy(*key).agg(F.min("conv_id").alias("node"), F.sum("members").alias("all_members"), F.count("*").alias("n_rows")),
        f"prefixes_{half}",
    )
    named = join_groups(keyed, groups.select(*key, "node", "n_rows"), key, "n_rows")
    upper = groups.select(
        "root", "start", F.col("node").alias("conv_id"), F.lit(half).cast("long").alias("length"),
        F.col("all_members").alias("members"), F.lit(False).alias("own"),
    )
    lower = named.where(F.col("length") > half).select(
        F.col("node").alias("root"), (F.col("start") + half).alias("start"), "conv_id", (F.col("length") - half).alias("length"),
        "members", "own",
    )
    short = trees.where(F.col("length") < half)
    ends = named.where((F.col("length") == half) & F.col("own")).select("conv_id", "node", (F.col("start") + half).alias("depth"))
    return written(upper.unionByName(lower).unionByName(short), f"trees_{half}"), written(ends, f"ends_{half}")


def build(sequences: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of ``sequences`` (conv_id, pos, symbol, size) of the conversations ``members`` (conv_id, length).

    Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, size (of the last turn).
    Ends: conv_id, and the node (node, depth) where it ends.
    """
    top = members.agg(F.max("length").alias("longest"), F.min("conv_id").alias("root"), F.count("*").alias("n")).first()
    long = "CAST({} AS BIGINT) AS {}".format
    root = members.limit(0).selectExpr("conv_id", long("0", "depth"), long("NULL", "parent_conv_id"), long("0", "n_convs"), long("0", "size"))
    ends = members.where("length = 0").select("conv_id", F.lit(top["root"]).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"))
    if top["n"] == 0:
        return root, ends
    root = members.sparkSession.createDataFrame([(top["root"], 0, None, top["n"], 0)], root.schema)
    if top["longest"] == 0:
        return root, ends
    height = 1
    while height < top["longest"]:
        height *= 2
    blocks = _blocks(sequences, height)
    trees = members.where("length > 0").select(
        F.lit(top["root"]).cast("long").alias("root"), F.lit(0).cast("long").alias("start"), "conv_id", "length",
        F.lit(1).cast("long").alias("members"), F.lit(True).alias("own"),
    )
    half = height // 2
    while half:
        trees, met = _cut(trees, blocks[half], half)
        ends = ends.unionByName(met)
        half //= 2
    # trees of height 1: one turn below their root
    turn = sequences.select("conv_id", F.col("pos").alias("start"), "symbol", "size")
    keyed = written(trees.join(turn, ["conv_id", "start"]), "edges")
    key = ["root", "start", "symbol"]
    groups = written(
        keyed.groupBy(*key).agg(
            F.min("conv_id").alias("node"), F.sum("members").alias("n_convs"), F.max("size").alias("size"), F.count("*").alias("n_rows")
        ),
        "edge_groups",
    )
    nodes = groups.select(
        F.col("node").alias("conv_id"), (F.col("start") + 1).alias("depth"), F.col("root").alias("parent_conv_id"), "n_convs", "size"
    )
    last = written(keyed.where("own"), "last_turns")
    met = join_groups(last, groups.select(*key, "node"), key).select("conv_id", "node", (F.col("start") + 1).alias("depth"))
    return written(root.unionByName(nodes), "nodes"), written(ends.unionByName(met), "ends")


# ---------------------------------------------------------------- grafts


def graft(nodes: DataFrame, own: DataFrame, *values: str) -> DataFrame:
    """conv_id, depth and the sums of ``values`` (columns of ``own``) over each node's subtree."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    totals = own.select(*NODE, *values)
    if not deepest:
        return totals
    # ancestors at distance 1 .. h of the nodes whose depth is a multiple of h
    above = nodes.where("depth > 0").select(*NODE, F.col("parent_conv_id").alias("above"), F.lit(1).cast("long").alias("distance"))
    h = 1
    while h <= deepest:
        cut = above.where(F.col("depth") % (2 * h) == h).join(totals, NODE)
        added = cut.select(F.col("above").alias("conv_id"), (F.col("depth") - F.col("distance")).alias("depth"), *values)
        totals = written(totals.unionByName(added).groupBy(*NODE).agg(*(F.sum(v).alias(v) for v in values)), f"totals_{h}")
        if 2 * h <= deepest:
            kept = above.where(F.col("depth") % (2 * h) == 0)
            at = kept.where(F.col("distance") == h).select(
                F.col("conv_id").alias("of"), F.col("depth").alias("of_depth"), F.col("above").alias("conv_id"), (F.col("depth") - h).alias("depth")
            )
            further = at.join(above, NODE).select(
                F.col("of").alias("conv_id"), F.col("of_depth").alias("depth"), "above", (F.col("distance") + h).alias("distance")
            )
            above = written(kept.unionByName(further), f"above_{2 * h}")
        h *= 2
    return totals


# ---------------------------------------------------------------- digests of the ends


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids, ascending, as text of at most IDS ids."""
    node, ids, out = None, [], []

    def flush():
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for conv, depth, member in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (conv, depth) != node or len(ids) >= IDS:
                flush()
                node = (conv, depth)
            ids.append(member)
        yield _text_rows(out)
        out.clear()
    flush()
    yield _text_rows(out)


def _text_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "depth", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, state = None, None
    for batch in batches:
        out = []
        for conv, depth, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (conv, depth) == node:
                state.update(b",")
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (conv, depth), hashlib.sha256()
            state.update(text.encode())
        yield _digest_rows(out)
    if node is not None:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes where conversations end.

    The ids of a node are sorted and joined by many tasks; only the digest itself, which is
    sequential, is made by one, over strings of IDS ids.
    """
    rows = ends.select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    ranged = rows.repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
    texts = written(ranged.mapInArrow(_joined_ids, "conv_id long, depth long, first long, ids string"), "end_ids")
    together = texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return together.select("conv_id", "depth", "ids").mapInArrow(_hashed_ids, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(sequences: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the sequences.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    nodes, ends = build(sequences, members)
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children")
    )
    full = written(nodes.join(children, NODE, "left").fillna(0, "n_children"), "full_nodes")
    own = full.select(
        *NODE, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")
    )
    totals = graft(full, own, "n_leaves", "saved_tokens")
    rows = full.join(totals, NODE).join(end_digests(ends), NODE, "left").fillna(NOTHING, "ends_sha256")
    return rows.select(*NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt with the opening turns of their groups."""
    return prefix_trie(*rebuilt(ordered_turns(conversations)))
