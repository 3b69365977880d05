"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is a run of `window` consecutive item words (a shorter item is one window).  A document
contains a window only if it contains every shingle of it, so joining on one shingle per window is
enough: the prefix of a set that must be contained whole has length one.  Shingles are ordered by
the number of documents that have them, over all documents, and the rarest is the prefix.

1. `item_shingles`: every shingle of every window and its offset in the window.
2. `shingle_rarity`: documents per item shingle; partial counts leave the map tasks.
3. `candidates`: one pass over the documents; only prefix shingles leave it, with their position
   and the words around it.  Which shingles are prefixes is known to the tasks as a bitmap of bounded
   size, so neither a large benchmark nor a large corpus is broadcast; false hits die in the join.
4. Join on the shingle, then the bounds: the window must begin at or after word 0 and end at or
   before the last word (length and position), and its words must equal the document's there.

Defined cases: null or wordless text has no words and no hits; null or wordless items have no
window; items with one id are one item; repeated document rows each get the full result; a null
doc_id is a key like any other; other columns are ignored; an empty table gives no rows; a text of any
length is read whole, and what it hits leaves in small batches; windows equally rare by two shingles take the
smaller shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.llm.words import ALNUM, mix, shingles, slices, split_words
from marisma.session import cut_lineage


@dataclass(frozen=True)
class WindowConfig:
    window: int = 10
    shingle: int = 3
    #: the bitmap has 16 bits per item shingle, at least 2^22, and never more than this
    bitmap_bits: int = 1 << 28


def item_shingles(items: DataFrame, cfg: WindowConfig) -> DataFrame:
    """item_id, span (the window's words, blank-joined), length, k, offset, shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for first, last, data, bounds in slices(batch.column("text")):
                w = split_words(data, bounds, ALNUM)
                rows = []
                for i in range(last - first):
                    lo, hi = int(w.first[i]), int(w.first[i + 1])
                    if lo == hi:
                        continue
                    size = min(cfg.window, hi - lo)
                    k = min(cfg.shingle, size)
                    words = [w.word(j).decode() for j in range(lo, hi)]
                    marks = shingles(w.hash[lo:hi], k).view(np.int64)
                    for at in range(hi - lo - size + 1):
                        span = " ".join(words[at : at + size])
                        rows += [(ids[first + i], span, size, k, o, int(marks[at + o])) for o in range(size - k + 1)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)],
                        names=["item_id", "span", "length", "k", "offset", "shingle"],
                    )

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "item_id long, span string, length int, k int, offset int, shingle long"
    )


class Bitmap:
    """Which shingles are wanted, in a bounded number of bits, whatever their number."""

    def __init__(self, marks: DataFrame, most: int):
        """marks: k, shingle.  At most bits numbers reach the driver."""
        count = marks.agg(F.approx_count_distinct("shingle")).first()[0]
        self.bits = bits = min(most, 1 << max(22, (16 * count - 1).bit_length()))
        slots = marks.select(F.pmod("shingle", F.lit(bits)).cast("int").alias("slot")).distinct().toArrow().column("slot").to_numpy()
        flags = np.zeros(bits, bool)
        flags[slots] = True
        self.shared = marks.sparkSession.sparkContext.broadcast(np.packbits(flags).tobytes())
        self.sizes = sorted(r.k for r in marks.select("k").distinct().collect())  # at most cfg.shingle values

    def finder(self):
        packed = np.frombuffer(self.shared.value, np.uint8)
        mask = np.uint64(self.bits - 1)

        def wanted(marks: np.ndarray) -> np.ndarray:
            slots = (marks & mask).astype(np.int64)
            return ((packed[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).astype(bool)

        return wanted


def _hits(h: np.ndarray, first: np.ndarray, k: int, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, word positions in the slice, and shingles that are wanted and lie inside one text."""
    if len(h) < k:
        return (np.zeros(0, np.int64),) * 2 + (h[:0],)
    marks = shingles(h, k)
    at = np.flatnonzero(wanted(marks))
    text = np.searchsorted(first, at, "right") - 1
    inside = at + k <= first[text + 1]
    return text[inside], at[inside], marks[at[inside]]


def shingle_rarity(docs: DataFrame, marks: DataFrame, cfg: WindowConfig) -> DataFrame:
    """shingle, docs: in how many documents each wanted shingle occurs (absent ones are missing)."""
    bitmap = Bitmap(marks, cfg.bitmap_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bitmap.finder()
        for batch in batches:
            seen = []
            for _, _, data, bounds in slices(batch.column("text")):
                w = split_words(data, bounds, ALNUM)
                for k in bitmap.sizes:
                    text, _, found = _hits(w.hash, w.first, k, wanted)
                    pairs = np.unique(np.stack([text.astype(np.uint64), found], axis=1), axis=0)
                    seen.append(pairs[:, 1])
            values, counts = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))], names=["shingle", "docs"])

    return (
        docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "shingle long, docs long")
        .groupBy("shingle").agg(F.sum("docs").alias("docs"))
    )


def window_prefixes(parts: DataFrame, rarity: DataFrame) -> DataFrame:
    """span, length, k, offset, shingle: the rarest shingle of each distinct window."""
    return (
        parts.select("span", "length", "k", "offset", "shingle").distinct()
        .join(rarity, "shingle", "left")
        .groupBy("span", "length", "k")
        .agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), F.col("shingle"), F.col("offset"))).alias("least"))
        .select("span", "length", "k", "least.offset", "least.shingle")
    )


#: hits in one Arrow batch
HITS = 4096


def candidates(docs: DataFrame, prefixes: DataFrame, cfg: WindowConfig) -> DataFrame:
    """doc_id, text_key, n_words, shingle, at, before, words: a row per document (shingle null) and one per prefix
    shingle in it with the words around it.  Rows leave slice by slice, so frequent words fill no worker."""
    bitmap = Bitmap(prefixes, cfg.bitmap_bits)
    reach = cfg.window
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
    names = ["doc_id", "text_key", "n_words", "shingle", "at", "before", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bitmap.finder()
        for batch in batches:
            for row, last, data, bounds in slices(batch.column("text")):
                w = split_words(data, bounds, ALNUM)
                ids, keys, sizes = batch.column("doc_id").slice(row, last - row), _text_keys(w.hash, w.first), np.diff(w.first)
                none = [pa.nulls(last - row, t) for t in kinds[3:]]
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys), pa.array(sizes, pa.int64()), *none], names=names)
                for k in bitmap.sizes:
                    text, at, marks = _hits(w.hash, w.first, k, wanted)
                    lo = np.maximum(w.first[text], at - reach)
                    hi = np.minimum(w.first[text + 1], at + reach + k)
                    for a in range(0, len(at), HITS):
                        part = slice(a, a + HITS)
                        around = [b" ".join(w.word(j) for j in range(x, y)).decode() for x, y in zip(lo[part].tolist(), hi[part].tolist(), strict=True)]
                        t = text[part]
                        columns = (keys[t], sizes[t], marks[part].view(np.int64), at[part] - w.first[t], at[part] - lo[part], around)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(t)), *[pa.array(c, kind) for c, kind in zip(columns, kinds[1:], strict=True)]], names=names
                        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, text_key long, n_words long, shingle long, at int, before int, words string"
    )


def _text_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One number for a text's words in order; rows alike in id and key have the same result."""
    place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ mix(place.astype(np.uint64) + np.uint64(1))))])
    return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def find_windows(docs: DataFrame, items: DataFrame, cfg: WindowConfig | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), contaminated; one row per input row.

    n_hit counts the document's words that lie in any occurrence of a window of an item.
    """
    cfg = cfg or WindowConfig()
    parts = cut_lineage(item_shingles(items, cfg), "windows")
    prefixes = cut_lineage(window_prefixes(parts, shingle_rarity(docs, parts.select("k", "shingle"), cfg)), "prefixes")
    scanned = cut_lineage(candidates(docs, prefixes, cfg), "scanned")

    start = F.col("at") - F.col("offset")
    spots = (
        scanned.filter("shingle IS NOT NULL").join(prefixes, "shingle")
        .filter((start >= 0) & (start + F.col("length") <= F.col("n_words")))
        .filter(F.array_join(F.slice(F.split("words", " "), F.greatest(F.col("before") - F.col("offset") + 1, F.lit(1)), F.col("length")), " ") == F.col("span"))
        .select("doc_id", "text_key", start.alias("start"), (start + F.col("length")).alias("stop"), "span")
    )
    spots = cut_lineage(spots, "spots")
    key = ["doc_id", "text_key"]
    # stretches in order; "reach" is the end of what is counted so far
    hit = spots.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs")).select(
        *key,
        F.expr("""aggregate(runs, struct(CAST(0 AS BIGINT) AS n, 0 AS reach),
                  (s, r) -> struct(s.n + greatest(0, r.stop - greatest(r.start, s.reach)) AS n, greatest(s.reach, r.stop) AS reach), s -> s.n)""").alias("n_hit"),
    )
    named = (
        spots.select(*key, "span").distinct().join(parts.select("span", "item_id").distinct(), "span")
        .groupBy(*key).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    same = lambda other: (F.col("s.doc_id").eqNullSafe(F.col(f"{other}.doc_id"))) & (F.col("s.text_key") == F.col(f"{other}.text_key"))
    return (
        scanned.filter("shingle IS NULL").select(*key, "n_words").alias("s").join(hit.alias("h"), same("h"), "left").join(named.alias("i"), same("i"), "left")
        .select(
            "s.doc_id", "s.n_words", F.coalesce("h.n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("i.item_ids", F.array().cast("array<string>")).alias("item_ids"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
