"""Merkle manifest of a table: a tree of digests per group, the groups' roots under one root, proofs.

1. `leaves`: a digest per row over length-prefixed fields.
2. `climb`: leaves, in order, are dealt into aligned blocks of 8 ** 3.  A block keeps each of its levels as
   a list of digests: parents are digests of slices of 8.  The roots of the blocks are the leaves of the
   next tier, and so on until a group has one node.
3. `descend`: a block knows the siblings of each of its leaves as the slices that flank it in its run,
   level by level; the siblings above come from the block of its root, one tier up.  `ways_up`: the leaves
   of a run share all that is above the run.
4. A proof is folded from a leaf and its flanks; it holds if that gives the root.

A task holds one block, of bounded size, whatever the group's size.  Ten billion leaves are four tiers.

Defined cases: a null field is `-`; a null group is a group, before all others; a null id comes first
in its group; rows that share an id come by their digest, repeated rows are leaves of their own; an empty
text is `0:`; a text of any length is one digest; other columns are ignored; a group of one row is its leaf;
an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.llm.runs import above
from marisma.session import cut_lineage

RUN, LEVELS = 8, 3
BLOCK = RUN**LEVELS
PATH = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def parents(level: Column) -> Column:
    """The next level of a list of digests."""
    runs = F.sequence(F.lit(1), F.size(level), F.lit(RUN))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(level, i, RUN), "")))


def flanks(level: Column, at: Column) -> Column:
    """Left and right siblings of the digest at a place of a level."""
    off = at % RUN
    left, right = F.slice(level, at - off + 1, off), F.slice(level, at + 2, RUN - 1 - off)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tiers of blocks, the lowest first; nodes: key, at (from 0), n (nodes of the key), node, more.

    A block: key, at, n, items (place in the block, node, more), l1..l3, top, last (it is the key's only one).
    """
    tiers = []
    while True:
        more = [c for c in nodes.columns if c not in ("key", "at", "n")]
        made = nodes.groupBy("key", F.expr(f"at DIV {BLOCK}").alias("at")).agg(
            F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct((F.col("at") % BLOCK).cast("int").alias("place"), *more))).alias("items")
        ).withColumn("last", F.col("n") <= BLOCK).withColumn("l0", F.transform("items", lambda x: x["node"]))
        for k in range(1, LEVELS + 1):
            below = F.col(f"l{k - 1}")
            made = made.withColumn(f"l{k}", F.when(~(F.col("last") & (F.size(below) == 1)), parents(below)))
        top = F.coalesce(*[f"l{k}" for k in range(LEVELS, -1, -1)])
        made = cut_lineage(made.withColumn("top", F.get(top, F.lit(0))).drop("l0"), "tier")
        tiers.append(made)
        nodes = made.filter("NOT last").select("key", "at", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("node"))
        if nodes.isEmpty():
            return tiers


def roots(tiers: list[DataFrame]) -> DataFrame:
    """key, root."""
    return reduce(DataFrame.unionByName, [t.filter("last").select("key", F.col("top").alias("root")) for t in tiers])


def descend(tiers: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The lowest tier's blocks with their way up from the top: path and the columns of heads (key, path, more)."""
    more = [c for c in heads.columns if c not in ("key", "path")]
    ways = None
    for tier in reversed(tiers):
        ends = tier.filter("last").select("key", "at").join(heads, "key")
        placed = tier.join(ends if ways is None else ends.unionByName(ways), ["key", "at"])
        ways = ways_up(placed, "key", F.col("at").alias("block"), *more).select(
            "key", (F.col("block") * BLOCK + F.col("x.place")).alias("at"), *more, "path"
        )
    return placed


def ways_up(blocks: DataFrame, *more: Column | str) -> DataFrame:
    """A row per item of the blocks: more, x (the item) and path (its flanks up to the root); path: from the block's root up."""
    hashed, empty = F.col("l1").isNotNull(), F.array().cast(PATH)

    def run(first: Column) -> Column:
        inside = [
            F.when(F.col(f"l{k + 1}").isNotNull(), F.array(flanks(F.col(f"l{k}"), F.floor(first / RUN**k).cast("int")))).otherwise(empty)
            for k in range(1, LEVELS)
        ]
        return F.struct(F.slice("items", first + 1, RUN).alias("items"), F.concat(*inside, F.col("path")).alias("path"))

    firsts = F.sequence(F.lit(0), F.size("items") - 1, F.lit(RUN))
    runs = blocks.select(*more, hashed.alias("hashed"), F.explode(F.transform(firsts, run)).alias("run"))
    rows = runs.select("*", F.posexplode("run.items").alias("spot", "x"))
    own = F.when(F.col("hashed"), F.array(flanks(F.col("run.items.node"), F.col("spot")))).otherwise(empty)
    return rows.withColumn("path", F.concat(own, F.col("run.path"))).drop("hashed", "run", "spot")


def fold(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda node, p: digest(F.concat(p["left"], node, p["right"])))


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def numbered(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with at, from 0 within each key, and n, the key's rows."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    placed = above(rows, keys, order, {"at": (F.lit(1).cast("long"), F.sum)})
    return placed.join(sizes, keys)


def manifest(rows: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified; rows: id, group, leaf, claim.

    claim is the leaf as someone else found it; what is folded is the claim with the siblings of the manifest.
    Rows are read once: leaves are written before they are ordered, counted and dealt.
    """
    named = rows.select("id", F.coalesce(F.concat(F.lit("s"), F.col("group").cast("string")), F.lit("n")).alias("key"), F.col("leaf").alias("node"), "claim")
    tiers = climb(numbered(cut_lineage(named, "leaves"), ["key"], [F.asc_nulls_first("id"), F.asc("node")]))
    # n (a null group) comes before s...
    tops = roots(tiers).select(F.lit("all").alias("key"), F.col("key").alias("name"), F.col("root").alias("node"))
    above_tiers = climb(numbered(tops, ["key"], [F.asc("name")]))
    heads = descend(above_tiers, roots(above_tiers).select("key", F.array().cast(PATH).alias("path"), "root"))
    heads = ways_up(heads, "root").select(F.col("x.name").alias("key"), F.col("x.node").alias("subroot"), "path", "root")
    lowest = ways_up(descend(tiers, cut_lineage(heads, "heads")), "subroot", "root")
    return lowest.select(
        "x.id", F.col("x.node").alias("leaf"), "subroot", "root",
        digest(siblings(F.col("path"))).alias("proof_sha256"), fold(F.col("x.claim"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
