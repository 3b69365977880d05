"""Stored vectors in cells, and an exact search that leaves cells out.

Centres are learnt from a bounded sample; every vector lies, at unit length, in the cell of its nearest
centre, and a cell knows the distance of its farthest member.  On unit vectors cosine order is distance
order, and by the triangle inequality nothing in a cell is nearer to a query than the query's distance
to the centre less that radius.  A search first scans the nearest cells that hold k vectors; the k-th
distance found there rules cells out, the others are scanned.  The result equals a full scan, whatever the
centres are; they only decide how much is read.

Queries are rows.  A cell is scanned in tiles of bounded size, some of its vectors with some of the
queries that ask for it, so a hot cell or a cell that all queries ask for is many tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.operators.search import first_k, top_k
from marisma.session import cut_lineage

SLACK = 1e-6
ROWS_IN_TILE, QUERIES_IN_TILE = 4096, 1024
QUERIES_AT_ONCE = 128  # of a tile, or to be sent their ways


@dataclass(frozen=True)
class VectorCells:
    """Folder of the cells; centres, and what each cell holds: number and radius, a number per cell."""

    root: str
    key: str
    key_type: str
    centres: np.ndarray
    size: np.ndarray
    radius: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        """celda, trozo, key, unidad."""
        return spark.read.schema(f"trozo int, {self.key} {self.key_type}, unidad array<double>, celda int").parquet(f"{self.root}/cells")


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the places of those that have a direction."""
    good = [i for i, v in enumerate(vectors) if v is not None and len(v)]
    if not good:
        return np.zeros((0, 0)), np.zeros(0, int)
    m = np.stack([np.asarray(vectors[i], dtype=np.float64) for i in good])
    n = np.linalg.norm(m, axis=1)
    keep = np.isfinite(n) & (n > 0)
    return m[keep] / n[keep, None], np.array(good)[keep]


def learn_centres(vectors: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres by alternating assignment and means; at most one per distinct vector."""
    distinct = np.unique(vectors, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:cells]]
    for _ in range(rounds):
        at = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, vectors)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(n > 0, sums / np.where(n > 0, n, 1), centres)
    return centres


def build_cells(table: DataFrame, key: str, vector: str, root: str, cells: int = 64, sample: int = 20_000) -> VectorCells:
    """Cells of a table below root.  sample: vectors the centres are learnt from, first by hash; all vectors are stored.

    A vector that is null, zero or not finite is near nothing and is left out, as a scan leaves it out.
    """
    spark = table.sparkSession
    key_type = table.schema[key].dataType.simpleString()
    some = table.select(vector).orderBy(F.xxhash64(vector)).limit(sample).collect()
    units, _ = _unit([r[0] for r in some])
    centres = learn_centres(units, cells) if len(units) else np.zeros((0, 0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, at = _unit(pdf[vector].to_list())
            if len(at):
                sims = rows @ centres.T
                cell = sims.argmax(axis=1)
                far = np.sqrt(np.maximum(0, 2 - 2 * sims[np.arange(len(at)), cell]))
                yield pd.DataFrame({"celda": cell.astype(np.int32), key: pdf[key].to_numpy()[at], "unidad": list(rows), "lejos": far})

    placed = cut_lineage(table.select(key, vector).mapInPandas(place, f"celda int, {key} {key_type}, unidad array<double>, lejos double"), "placed")
    # a row per cell, and their number is a parameter
    held = placed.groupBy("celda").agg(F.count("*").alias("n"), F.max("lejos").alias("lejos")).collect()
    size, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in held:
        size[r["celda"]], radius[r["celda"]] = r["n"], r["lejos"]
    parts = F.get(F.array(*[F.lit(int(max(1, -(-n // ROWS_IN_TILE)))) for n in size]) if len(size) else F.array(F.lit(1)), F.col("celda"))
    placed.select("celda", F.pmod(F.xxhash64(key, "unidad"), parts).cast("int").alias("trozo"), key, "unidad").hint("rebalance", "celda").write.partitionBy("celda").parquet(f"{root}/cells")
    return VectorCells(root, key, key_type, centres, size, radius)


def _ways(index: VectorCells, queries: DataFrame, qid: str, qvec: str, k: int) -> DataFrame:
    """qid, unidad, celda, cota (no member is nearer), primera (among the nearest cells that hold k vectors)."""
    qid_type = queries.schema[qid].dataType.simpleString()
    centres, size, radius = index.centres, index.size, index.radius

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), QUERIES_AT_ONCE):
                part = pdf.iloc[start : start + QUERIES_AT_ONCE]
                rows, at = _unit(part[qvec].to_list())
                if not len(at) or not len(centres):
                    continue
                away = np.sqrt(np.maximum(0, 2 - 2 * rows @ centres.T))
                bound = np.maximum(0, away - radius)
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                first = np.zeros_like(bound, dtype=bool)
                np.put_along_axis(first, order, before < k, axis=1)
                n = len(centres)
                yield pd.DataFrame({
                    qid: np.repeat(part[qid].to_numpy()[at], n), "unidad": [u for u in rows for _ in range(n)],
                    "celda": np.tile(np.arange(n, dtype=np.int32), len(at)), "cota": bound.ravel(), "primera": first.ravel(),
                })[np.tile(size > 0, len(at))]

    return queries.select(qid, qvec).mapInPandas(run, f"{qid} {qid_type}, unidad array<double>, celda int, cota double, primera boolean")


def _scan(index: VectorCells, ways: DataFrame, qid: str, k: int) -> DataFrame:
    """(qid, key, similitud): per tile the k nearest of each query, equal ones by key; ways: qid, unidad, celda."""
    spark, key = ways.sparkSession, index.key
    qid_type = ways.schema[qid].dataType.simpleString()
    asked = ways.groupBy("celda").agg(F.ceil(F.count("*") / QUERIES_IN_TILE).cast("int").alias("_nq"))
    tiles = F.array(*[F.lit(int(max(1, -(-n // ROWS_IN_TILE)))) for n in index.size]) if len(index.size) else F.array(F.lit(1))
    of_query = ways.join(asked, "celda").select(
        "celda", F.pmod(F.xxhash64(qid), F.col("_nq")).cast("int").alias("grupo"), F.explode(F.sequence(F.lit(0), F.get(tiles, F.col("celda")) - 1)).alias("trozo"), qid, F.col("unidad").alias("_q")
    )
    # only cells that some query asks for are read
    of_row = index.rows(spark).join(asked, "celda").select("celda", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("grupo"), "trozo", key, "unidad")

    def near(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({qid: [], key: [], "similitud": []})
        rows = rows.sort_values(key, kind="stable", na_position="first")
        units, keys, asks = np.stack(rows["unidad"].to_numpy()), rows[key].to_numpy(), queries[qid].to_numpy()
        found = []
        for start in range(0, len(queries), QUERIES_AT_ONCE):
            some = slice(start, start + QUERIES_AT_ONCE)
            sims = units @ np.stack(queries["_q"].to_numpy()[some]).T
            at, of = np.nonzero(first_k(sims, k))
            found.append(pd.DataFrame({qid: asks[some][of], key: keys[at], "similitud": sims[at, of]}))
        return pd.concat(found)

    on = ["celda", "trozo", "grupo"]
    return of_row.groupBy(*on).cogroup(of_query.groupBy(*on)).applyInPandas(near, f"{qid} {qid_type}, {key} {index.key_type}, similitud double")


def search_cells(index: VectorCells, queries: DataFrame, k: int, qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """The k nearest rows per query by cosine, exact: qid, key, similitud, rango.  A query without a direction has no answer."""
    ways = cut_lineage(_ways(index, queries, qid, qvec, k), "ways")
    first = cut_lineage(top_k(_scan(index, ways.filter("primera"), qid, k), qid, "similitud", index.key, k), "first")
    reach = first.filter(F.col("rango") == k).select(qid, F.sqrt(F.greatest(2 - 2 * F.col("similitud"), F.lit(0.0))).alias("_t"))
    open_ = ways.filter("NOT primera").join(reach, qid, "left").filter(F.col("_t").isNull() | (F.col("cota") <= F.col("_t") + SLACK))
    rest = _scan(index, cut_lineage(open_.select(qid, "unidad", "celda"), "open"), qid, k)
    return top_k(first.drop("rango").unionByName(rest), qid, "similitud", index.key, k)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
