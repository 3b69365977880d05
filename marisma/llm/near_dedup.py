"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. `sketch_documents`: per document the size and a digest of its set of word shingles, and
   `bands * rows` minima.  Documents with one set collapse to the smallest id that has it.
2. `candidate_stars`: documents that agree in a whole band belong to one star, led by the
   smallest id of the bucket.  A star holds every pair of its buckets, but one row per member;
   the leader comes from a pre-aggregated minimum, so no bucket is collected.
3. `verify_stars`: a star is cut into tiles of bounded size, first its blocks, each with the leader,
   then only what a cut star's members not linked to the leader may still link with.  Inside a tile
   pairs that are not yet connected are compared batch by batch of the signature and pruned as soon
   as the posterior chance of reaching the threshold is below `miss`; survivors are counted on the
   full shingle sets, and links are confirmed on the words.  Only a spanning forest leaves the tile.
4. `components`: alternating large-star and small-star steps over the links.

Missing a pair takes a similarity of at least the threshold with no equal band (for 0.8 and
32 bands of 4: 5e-8), or an unlucky signature (`miss`, per comparison).

Defined cases: null or wordless text has an empty set, size 0, and no links; fewer words than a
shingle give the whole sequence as one; a null doc_id joins nothing and stays; rows that repeat a
doc_id share its component; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.llm.words import SOLID, mix, shingles, slices, split_words
from marisma.session import cut_lineage


@dataclass(frozen=True)
class NearConfig:
    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    batch: int = 32
    miss: float = 1e-5
    tile_docs: int = 2048
    tile_shingles: int = 2_000_000
    seed: int = 1
    need: tuple[tuple[int, int], ...] = field(init=False)

    def __post_init__(self):
        total = self.bands * self.rows
        steps = [*range(self.batch, total, self.batch), total]
        object.__setattr__(self, "need", tuple((n, matches_needed(n, self.percent / 100, self.miss)) for n in steps))


def matches_needed(n: int, threshold: float, miss: float) -> int:
    """Fewest of n equal minima for which P(similarity >= threshold) is at least miss.

    Under a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at t is the
    chance of at most m successes in n + 1 draws with probability t.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n + 1


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for first, last, data, bounds in slices(column):
        w = split_words(data, bounds, SOLID)
        runs = shingles(w.hash, k) if len(w.hash) >= k else w.hash[:0]
        for i in range(last - first):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            if hi - lo >= k:
                yield np.unique(runs[lo : hi - k + 1])
            elif hi > lo:
                yield shingles(w.hash[lo:hi], hi - lo) + np.uint64(hi - lo)
            else:
                yield w.hash[:0]


def _permutations(cfg: NearConfig) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(cfg.seed)
    draw = rng.integers(0, 2**64, (2, cfg.bands * cfg.rows, 1), dtype=np.uint64)
    return draw[0], draw[1] | np.uint64(1)


def minima_of(s: np.ndarray, add: np.ndarray, times: np.ndarray) -> np.ndarray:
    best = np.full(len(add), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 4096):
        part = ((s[None, at : at + 4096] ^ add) * times) >> np.uint64(32)
        best = np.minimum(best, part.min(axis=1).astype(np.uint32))
    return best


def sketch_documents(docs: DataFrame, cfg: NearConfig) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and its minima (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        add, times = _permutations(cfg)
        for batch in batches:
            sizes, digests, minima = [], [], []
            for s in shingle_sets(batch.column("text"), cfg.shingle):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                minima.append(minima_of(s, add, times).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(minima, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "minima"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, minima binary"
    )


def candidate_stars(reps: DataFrame, cfg: NearConfig) -> DataFrame:
    """leader, doc_id, n_shingles: the leader is the smallest id of a shared bucket; it is a member too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = np.arange(1, cfg.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(n, cfg.bands, cfg.rows)
            key = np.broadcast_to(turn, (n, cfg.bands)).copy()
            for r in range(cfg.rows):
                key = mix(key ^ sig[:, :, r].astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.ravel().view(np.int64)),
                    pa.array(np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), cfg.bands)),
                    pa.array(np.repeat(batch.column("n_shingles").to_numpy(zero_copy_only=False), cfg.bands)),
                ],
                names=["bucket", "doc_id", "n_shingles"],
            )

    buckets = reps.select("doc_id", "n_shingles", "minima").mapInArrow(run, "bucket long, doc_id long, n_shingles long")
    led = (
        buckets.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.count("*").alias("size"))
        .filter("size > 1").select("bucket", "leader")
    )
    return buckets.join(led, "bucket").select("leader", "doc_id", "n_shingles").distinct()


def _blocks(docs: Column, load: Column, cfg: NearConfig) -> Column:
    return F.greatest(F.ceil(docs / cfg.tile_docs), F.ceil(load / cfg.tile_shingles)).cast("int")


def home_tiles(stars: DataFrame, cfg: NearConfig) -> DataFrame:
    """Cut stars into blocks of bounded size; a block is a tile of its own, and the leader is in all of them."""
    blocks = (
        stars.groupBy("leader").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("load"))
        .select("leader", F.greatest(_blocks(F.col("docs"), F.col("load"), cfg), F.lit(1)).alias("blocks"))
    )
    mine = F.when(F.col("doc_id") == F.col("leader"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    return (
        stars.join(blocks, "leader").withColumn("block", mine)
        .withColumn("low", F.explode(F.expr("CASE WHEN block < 0 THEN sequence(0, blocks - 1) ELSE array(block) END")))
        .select("leader", "low", F.col("low").alias("high"), "block", "doc_id", "n_shingles", "blocks")
    )


def loose_tiles(home: DataFrame, links: DataFrame, cfg: NearConfig) -> DataFrame:
    """What the home tiles leave open: members of cut stars that are not linked to their leader, with all others.

    A loose block meets every loose block and every block of linked members (numbered -2, -3, ...), so a
    linked member ships once per loose block, and not at all where nothing is loose.
    """
    linked = links.select(F.col("low").alias("leader"), F.col("high").alias("doc_id"), F.lit(False).alias("loose"))
    members = (
        home.filter("blocks > 1 AND block >= 0").select("leader", "doc_id", "n_shingles")
        .join(linked, ["leader", "doc_id"], "left").withColumn("loose", F.coalesce("loose", F.lit(True)))
    )
    count = lambda cond: (F.count_if(cond), F.coalesce(F.sum(F.when(cond, F.col("n_shingles"))), F.lit(0)))
    sizes = members.groupBy("leader").agg(
        _blocks(*count(F.col("loose")), cfg).alias("ublocks"), _blocks(*count(~F.col("loose")), cfg).alias("lblocks")
    ).filter("ublocks > 0")
    place = F.xxhash64("doc_id")
    block = F.when(F.col("loose"), F.pmod(place, F.col("ublocks"))).otherwise(-2 - F.pmod(place, F.greatest("lblocks", F.lit(1)))).cast("int")
    tiles = F.expr("""
        CASE WHEN loose THEN concat(transform(sequence(0, ublocks - 1), o -> struct(least(o, block) AS low, greatest(o, block) AS high)),
                                    transform(slice(sequence(0, lblocks), 2, lblocks), o -> struct(block AS low, -1 - o AS high)))
             ELSE transform(sequence(0, ublocks - 1), o -> struct(o AS low, block AS high)) END""")
    return (
        members.join(sizes, "leader").withColumn("block", block).withColumn("tile", F.explode(tiles))
        .select("leader", "tile.low", "tile.high", "block", "doc_id")
    )


def _share_percent(a: set, b: set, percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def word_shingles(text: str | None, k: int) -> set[tuple[str, ...]]:
    """The set itself, of words, for the last check."""
    table = {c: c + 32 for c in range(65, 91)}
    words = [w.translate(table) for w in _split(text or "")]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def _split(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]  # bytes split at ASCII white space only


class Tile:
    """Pairs of one tile; group holds what the links found so far connect, and that linked members are one."""

    def __init__(self, key, ids, blocks, texts: pa.Array, cfg: NearConfig):
        self.key, self.cfg, self.ids, self.blocks, self.texts = key, cfg, ids, blocks, texts
        self.draw = _permutations(cfg)
        self.sig = np.zeros((len(ids), cfg.bands * cfg.rows), np.uint32)
        self.drawn = np.zeros(len(ids), np.int64)
        self.sets = list(shingle_sets(texts, cfg.shingle))
        self.size = np.array([len(s) for s in self.sets])
        self.group = np.arange(len(ids))
        self.linked = np.flatnonzero(blocks < -1)
        self.group[self.linked] = self.linked[:1]

    def draw_until(self, n: int, docs: np.ndarray) -> None:
        """Minima up to n, for documents that still have a pair to compare."""
        for d in docs[self.drawn[docs] < n]:
            at = int(self.drawn[d])
            self.sig[d, at:n] = minima_of(self.sets[d], self.draw[0][at:n], self.draw[1][at:n])
            self.drawn[d] = n

    def likely(self, i: int, others: np.ndarray) -> np.ndarray:
        small, large = np.minimum(self.size[others], self.size[i]), np.maximum(self.size[others], self.size[i])
        others = others[100 * small >= self.cfg.percent * large]
        same, done = np.zeros(len(others), np.int64), 0
        for n, need in self.cfg.need:
            if not len(others):
                break
            self.draw_until(n, np.append(others, i))
            same += (self.sig[others, done:n] == self.sig[i, done:n]).sum(axis=1)
            keep = same >= need
            others, same, done = others[keep], same[keep], n
        return others

    def link(self, i: int, others: np.ndarray) -> None:
        """Compare i with others; links join their groups."""
        others = self.likely(i, others[self.group[others] != self.group[i]])
        words = None
        for at in range(0, len(others), 256):
            part = others[at : at + 256]
            part = part[self.group[part] != self.group[i]]
            if not len(part):
                continue
            hashes = np.concatenate([self.sets[o] for o in part])
            mine = self.sets[i]
            place = np.minimum(np.searchsorted(mine, hashes), len(mine) - 1)
            both = np.add.reduceat((mine[place] == hashes).astype(np.int64), np.concatenate([[0], np.cumsum(self.size[part])[:-1]]))
            for o in part[100 * both >= self.cfg.percent * (self.size[part] + len(mine) - both)]:
                if self.group[o] != self.group[i]:
                    words = word_shingles(self.texts[int(i)].as_py(), self.cfg.shingle) if words is None else words
                    if _share_percent(words, word_shingles(self.texts[int(o)].as_py(), self.cfg.shingle), self.cfg.percent):
                        self.group[self.group == self.group[o]] = self.group[i]

    def links(self) -> list[tuple[int, int]]:
        order = np.argsort(self.ids, kind="stable")
        leader = order[self.blocks[order] < 0]
        for i in leader:
            self.link(i, order[order != i])
        _, low, high = self.key
        left, right = order[self.blocks[order] == low], order[self.blocks[order] == high]
        if low == high:
            for n, i in enumerate(left):
                self.link(i, left[n + 1 :])
        else:
            for i in left if len(left) <= len(right) else right:
                self.link(i, right if len(left) <= len(right) else left)
        found = []
        told = np.ones(len(self.ids), bool)  # of the linked members one stands for all
        told[self.linked[1:]] = False
        for g in np.unique(self.group):
            members = self.ids[(self.group == g) & told]
            found += [(int(members.min()), int(m)) for m in members if m != members.min()]
        return found


def verify_stars(rows: DataFrame, cfg: NearConfig) -> DataFrame:
    """Links (low, high) of tiles; rows: leader, low, high, block, doc_id, text."""

    def runs(batches):
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("leader", "low", "high")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                now = tuple(keys[a])
                if held and now != key:
                    yield key, held
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield key, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for key, held in runs(batches):
            t = pa.Table.from_batches(held).combine_chunks()
            texts = t.column("text").combine_chunks()
            found += Tile(
                key, t.column("doc_id").to_numpy(), t.column("block").to_numpy(),
                texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, cfg,
            ).links()
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    return (
        rows.repartition("leader", "low", "high").sortWithinPartitions("leader", "low", "high")
        .mapInArrow(run, "low long, high long").distinct()
    )


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    low, high = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["low", "high"])


def components(links: DataFrame) -> DataFrame:
    """doc_id, component_id of every id in links (low, high): alternating large-star and small-star steps."""
    links = cut_lineage(links.filter("low < high").distinct(), "links")
    before = None
    while True:
        both = links.select("low", "high").union(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy("low").agg(F.least(F.min("high"), F.col("low")).alias("least"))
        large = both.join(least, "low").filter("high > low").select(F.col("least").alias("low"), "high").filter("low < high").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = (
            large.join(least, "high").select("least", F.explode(F.array("low", "high")).alias("high"))
            .select(F.col("least").alias("low"), "high").filter("low < high").distinct()
        )
        links = cut_lineage(small, "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        if now == before:
            return links.select(F.col("high").alias("doc_id"), F.col("low").alias("component_id")).union(
                links.select(F.col("low"), F.col("low")).distinct()
            )
        before = now


def near_duplicates(docs: DataFrame, cfg: NearConfig | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; docs: doc_id, text.  One row per input row."""
    cfg = cfg or NearConfig()
    sketch = cut_lineage(sketch_documents(docs, cfg), "sketch")
    # the first of each distinct set; a doc_id is compared once per set it has
    firsts = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    reps = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(firsts, ["digest", "doc_id"], "left_semi")
    stars = cut_lineage(candidate_stars(reps.select("doc_id", "n_shingles", "minima"), cfg), "stars")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # by merging, whatever the sizes: neither side is bounded
    verify = lambda dealt: verify_stars(dealt.hint("merge").join(texts, "doc_id"), cfg)
    home = home_tiles(stars, cfg)
    links = cut_lineage(verify(home.select("leader", "low", "high", "block", "doc_id")), "home_links")
    rest = cut_lineage(loose_tiles(home, links, cfg), "loose")
    found = components(links if rest.isEmpty() else links.union(verify(rest)))
    named = firsts.join(found, "doc_id", "left").select("digest", F.coalesce("component_id", "doc_id").alias("found"))
    return (
        sketch.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
