"""Text chunks and hashed vectors: small Arrow helpers, one row in, one array out."""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = ["\n\n", "\n", " ", ""]
WORDS_KNOWN = 100_000  # hashed words a task keeps


def split_text(body: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters, cut at the coarsest separator that fits, overlapping by whole parts."""
    sep = next((s for s in separators if s == "" or s in body), "")
    finer = separators[separators.index(sep) + 1:]
    parts = [p for p in body.split(sep) if p] if sep else list(body)
    out: list[str] = []
    fitting: list[str] = []
    for part in parts:
        if len(part) < size:
            fitting.append(part)
            continue
        out += _pack(fitting, sep, size, overlap)
        fitting = []
        out += split_text(part, size, overlap, finer) if finer else [part]
    return out + _pack(fitting, sep, size, overlap)


def _pack(parts: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Runs of neighbors joined by sep: each as long as fits in size, and no part is left out.

    A run begins with the longest tail of the one before that is within overlap and leaves room for the next part.
    """
    gap = len(sep)
    reach = [0, *accumulate(len(p) + gap for p in parts)]
    runs, start, stop = [], 0, 0
    while stop < len(parts):
        if stop:
            tail, room = bisect_left(reach, reach[stop] - gap - overlap), bisect_left(reach, reach[stop + 1] - gap - size)
            start = min(max(tail, room), stop)
        stop = max(bisect_right(reach, reach[start] + gap + size) - 1, stop + 1)
        runs.append(sep.join(parts[start:stop]).strip())
    return [r for r in runs if r]


def chunks(body: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of overlapping pieces of a text."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [p for p in split_text((t or "").strip(), size, overlap) if p.strip()])

    return cut(body)


def fixed_chunks(body: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Pieces at a fixed stride, as native expressions."""
    stride = size - overlap
    last = F.greatest(F.length(body) - F.lit(overlap) - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(stride))
    return F.when(
        F.length(body) > 0, F.transform(starts, lambda i: F.substr(body, i + 1, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def hash_vector(body: str, dim: int, known: dict[str, tuple[int, float]] | None = None) -> np.ndarray:
    """Signed bucket counts of the words, scaled to length one.  known keeps the places of words seen before."""
    known = {} if known is None else known
    counts = [0.0] * dim
    for word in (body or "").lower().split():
        place = known.get(word)
        if place is None:
            h = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16)
            place = (h % dim, 1.0 if (h >> 16) & 1 else -1.0)
            if len(known) >= WORDS_KNOWN:
                known.clear()
            known[word] = place
        counts[place[0]] += place[1]
    vec = np.array(counts)
    size = np.linalg.norm(vec)
    return (vec / size if size else vec).astype(np.float32)


def embed(body: Column, dim: int = 384, model=None) -> Column:
    """Text to unit vector.

    model: a function that returns an encoder (list of texts -> list of vectors);
    it is called once per task.  Without one, words are hashed.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, float]] = {}
        encoder = model() if model else (lambda texts: [hash_vector(t, dim, known) for t in texts])
        for texts in batches:
            yield pd.Series(list(encoder(texts.tolist())), index=texts.index)

    return encode(body)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
