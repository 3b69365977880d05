"""The tree of shared beginnings of conversations, by ROLLUP over positional turn columns.

1. `ordered_turns`: place and digest of each turn; texts are left behind where they are read.
2. `blocks`: a conversation is cut into rows of `width` turn columns.  A block is keyed by the node at
   which the block before it ends: the exclusive or of the digests of (place, turn) above it, 128 bits.
   That key is a running aggregate, so all blocks of all conversations are known at once and a long
   conversation needs no round per block.
3. One `GROUP BY start, key, ROLLUP (t1, ..., tn)` aggregates the prefixes of all lengths; grouping_id
   tells how long a prefix is.
4. Totals over subtrees: each node belongs to its smallest member.  Of the members of a node only the
   smallest owns nodes above it, so a subtree's total is the sum of what its members own (a second
   ROLLUP) minus what the smallest owns further up (a running sum).
5. `ends`: ids of the conversations that end at a node are joined into pieces of bounded size where
   they lie sorted, and the pieces hashed one after the other.

Defined cases: a null role or text counts as empty; turns come by number, null first, those of one
number by the digest of role and text; repeated turns are turns; a null conv_id is no conversation and
its rows are left out; other columns are ignored; an empty table has no root and gives no rows.  A text
of any length is one digest; a conversation or a node of any size is cut into bounded rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.llm.runs import above
from marisma.session import cut_lineage

NODE = ["depth", "a", "b"]


def turn_digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, words."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    numbered = above(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("digest")], {"pos": (F.lit(1).cast("long"), F.sum)})
    return numbered.select("conv_id", (F.col("pos") + 1).alias("pos"), "digest", "words")


def blocks(members: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """conv_id, start (turns above), above_a, above_b, t1...tn, n_turns, xor_a, xor_b; a member without turns has an empty first block."""
    rows = turns.select(
        "conv_id", (F.floor((F.col("pos") - 1) / width) * width).cast("long").alias("start"), ((F.col("pos") - 1) % width).cast("int").alias("slot"),
        F.xxhash64("pos", "digest").alias("a"), F.xxhash64("digest", "pos").alias("b"), "words", F.lit(1).cast("long").alias("one"),
    ).union(members.select("conv_id", *[F.lit(v).cast(t) for v, t in ((0, "long"), (-1, "int"), (0, "long"), (0, "long"), (0, "long"), (0, "long"))]))
    wide = rows.groupBy("conv_id", "start").agg(
        *[F.max(F.when(F.col("slot") == i, F.struct("a", "b", "words"))).alias(f"t{i + 1}") for i in range(width)],
        F.bit_xor("a").alias("xor_a"), F.bit_xor("b").alias("xor_b"), F.sum("one").alias("n_turns"),
    )
    return cut_lineage(
        above(wide, ["conv_id"], [F.asc("start")], {"above_a": (F.col("xor_a"), F.bit_xor), "above_b": (F.col("xor_b"), F.bit_xor)}), "blocks"
    )


def rolled_up(rows: DataFrame, width: int, what: str) -> DataFrame:
    """One row per node: depth, a, b, tip (its last turn, null at the root), and the aggregates `what`."""
    turns = [f"t{i + 1}" for i in range(width)]
    groups = rows.sparkSession.sql(
        f"SELECT start, above_a, above_b, {', '.join(turns)}, {width} - bit_count(grouping_id()) AS level, {what} "
        f"FROM {{rows}} GROUP BY start, above_a, above_b, ROLLUP ({', '.join(turns)})", rows=rows,
    )
    tip = F.when(F.col("level") > 0, F.get(F.array(*turns), F.col("level") - 1))
    # the root of a later block is the last node of the block before; a level beyond a conversation's end is no node
    groups = groups.withColumn("tip", tip).filter("tip IS NOT NULL OR (level = 0 AND start = 0)")
    key = {x: f"above_{x} ^ " + " ^ ".join(f"coalesce({t}.{x}, 0)" for t in turns) for x in "ab"}
    return groups.select((F.col("start") + F.col("level")).cast("long").alias("depth"), *[F.expr(e).alias(x) for x, e in key.items()], "*").drop(
        "start", "above_a", "above_b", "level", *turns
    )


def joined_ids(rows: DataFrame, piece: int = 4096) -> DataFrame:
    """depth, a, b, ends_sha256: SHA-256 of the decimal ids of each node, ascending, comma-joined; rows: depth, a, b, conv_id."""

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list]]:
        keys = list(zip(*(batch.column(c).to_pylist() for c in NODE), strict=True))
        values = batch.column(3).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start] or i - start == piece:
                yield keys[start], values[start:i]
                start = i

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*key, ids[0], ",".join(map(str, ids))) for key, ids in runs(batch)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=[*NODE, "first", "ids"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*NODE, "ends_sha256"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, digest.hexdigest())], names=[*NODE, "ends_sha256"])

    pieces = (
        rows.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
        .mapInArrow(cut, "depth long, a long, b long, first long, ids string")
    )
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(add_up, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(members: DataFrame, turns: DataFrame, width: int = 8) -> DataFrame:
    """One row per node of the tree; members: conv_id, each once; turns: conv_id, pos (1, 2, ...), digest, words.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves (of the subtree),
    saved_tokens (of the subtree: words of a node's last turn, for every member but one), ends_sha256.
    """
    rows = blocks(members, turns, width)
    nodes = rolled_up(rows, width, "min(conv_id) AS conv_id, count(*) AS n_convs")
    nodes = cut_lineage(nodes.select(
        *NODE, (F.col("depth") - 1).alias("up"), F.expr("a ^ coalesce(tip.a, 0)").alias("up_a"), F.expr("b ^ coalesce(tip.b, 0)").alias("up_b"),
        "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.coalesce("tip.words", F.lit(0))).alias("own"),
    ), "nodes")
    children = nodes.filter("depth > 0").groupBy("up", "up_a", "up_b").agg(F.count("*").alias("n_children")).select(
        F.col("up").alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"), "n_children"
    )
    counted = nodes.join(children, NODE, "left").fillna(0, ["n_children"])
    counted = cut_lineage(above(counted, ["conv_id"], [F.asc("depth")], {"own_above": (F.col("own"), F.sum)}), "counted")
    owned = counted.groupBy("conv_id").agg(F.sum("own").alias("own"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    totals = rolled_up(rows.join(owned, "conv_id", "left"), width, "sum(own) AS total, sum(leaves) AS n_leaves").drop("tip")
    finals = rows.groupBy("conv_id").agg(F.sum("n_turns").alias("depth"), F.bit_xor("xor_a").alias("a"), F.bit_xor("xor_b").alias("b"))
    parents = nodes.select(F.col("depth").alias("up"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    return (
        counted.join(totals, NODE).join(joined_ids(finals), NODE, "left").join(parents, ["up", "up_a", "up_b"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
            (F.coalesce("total", F.lit(0)) - F.col("own_above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
