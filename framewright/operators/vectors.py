"""A stored index of vectors: created, opened, appended to, and asked for the most similar vectors of a query.

Vectors are dealt to cells of similar ones by centres that are fitted on a bounded sample; a query looks at the
vectors of the cells whose centres are most similar to it, or of all cells. Similarities are exact cosines.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.operators.dedup import matrix
from framewright.session import cut

#: Vectors that the centres are fitted on at most, vectors that a cell aims at, and cells at most (their centres are sent
#: to the workers).
SAMPLE, CELL, MOST_CELLS = 20_000, 2000, 4096
#: Cells that a query looks at.
PROBES = 16
#: Vectors of a cell that are compared at a time.
BLOCK = 4096


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def fit(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of unit vectors."""
    rng = np.random.default_rng(0)
    out = vectors[rng.permutation(len(vectors))[:count]]
    for _ in range(rounds):
        own = (vectors @ out.T).argmax(axis=1)
        members = np.zeros((len(out), len(vectors)), np.float32)
        members[own, np.arange(len(vectors))] = 1
        sums = members @ vectors
        empty = members.sum(axis=1) == 0
        sums[empty] = vectors[rng.integers(0, len(vectors), int(empty.sum()))]
        out = unit_rows(sums)
    return out


class VectorIndex:
    """rows: (id, vec, cell, batch) as Parquet, divided by batch; ids are bigint, vectors of one length and not all
    zero (others are left out). An append replaces its own batch."""

    def __init__(self, spark: SparkSession, folder: str, centres: np.ndarray):
        self.spark, self.folder, self.centres = spark, folder.rstrip("/"), centres

    @classmethod
    def create(cls, spark: SparkSession, folder: str, rows: DataFrame, batch: int = 0, sample: int = SAMPLE, cell: int = CELL) -> VectorIndex:
        """An index of rows (id, vec), of which about `sample` fit the centres; all of the most frequent length are stored."""
        lengths = rows.where(F.size("vec") > 0).groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "size").first()
        if lengths is None:
            raise ValueError("no vectors to fit the centres on")
        n = lengths["n"]
        picked = rows.where((F.size("vec") == lengths["size"]) & (F.xxhash64("id").bitwiseAND((1 << 31) - 1) < int(min(1.0, sample / max(n, 1)) * (1 << 31)))).select("vec").limit(2 * sample).toArrow()
        m = matrix(picked.column("vec")).astype(np.float32)
        m = m[(m != 0).any(axis=1)] if len(m) else m
        if not len(m):
            raise ValueError("no vectors to fit the centres on")
        count = int(min(MOST_CELLS, max(1, round(n / cell)), max(1, len(m) // 4)))
        index = cls(spark, folder, fit(unit_rows(m), count))
        spark.createDataFrame([(json.dumps({"size": index.centres.shape[1], "cells": count}), index.centres.astype(np.float32).tobytes())], "settings string, centres binary").coalesce(1).write.mode("errorifexists").parquet(f"{index.folder}/centres")
        index.append(rows, batch)
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        r = spark.read.parquet(f"{folder.rstrip('/')}/centres").first()
        size = json.loads(r["settings"])["size"]
        return cls(spark, folder, np.frombuffer(bytes(r["centres"]), np.float32).reshape(-1, size))

    def __len__(self) -> int:
        return self.rows().count()

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id bigint, vec array<float>, cell int, batch bigint").parquet(f"{self.folder}/rows")

    def append(self, rows: DataFrame, batch: int) -> None:
        placed = self._placed(rows.select(F.col("id").cast("bigint").alias("id"), "vec"), 1).withColumn("batch", F.lit(batch).cast("bigint"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/rows")

    def _placed(self, rows: DataFrame, probes: int | None) -> DataFrame:
        """(id, vec, cell) with one row per cell that a vector belongs to or asks."""
        shared = self.spark.sparkContext.broadcast(self.centres)
        size = self.centres.shape[1]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = matrix(batch.column("vec")).astype(np.float32)
                good = np.flatnonzero(np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)) if len(m) else np.empty(0, np.int64)
                k = min(probes or len(shared.value), len(shared.value))
                sims = unit_rows(m[good]) @ shared.value.T if len(good) else np.zeros((0, len(shared.value)))
                cells = np.argpartition(-sims, k - 1, axis=1)[:, :k] if len(good) else np.zeros((0, k), np.int64)
                at = pa.array(np.repeat(good, k))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("vec").take(at), pa.array(cells.ravel(), pa.int32())], names=["id", "vec", "cell"])

        usable = rows.where(F.col("vec").isNotNull() & (F.size("vec") == size)).select("id", F.col("vec").cast("array<float>").alias("vec"))
        return usable.mapInArrow(place, "id bigint, vec array<float>, cell int")

    def _compared(self, queries: DataFrame, probes: int | None, keep) -> DataFrame:
        """(query, id, sim) of what `keep` selects of each product of a cell's queries and one block of its vectors."""
        asked = self._placed(queries, probes)
        held = self.rows()
        sizes = {r["cell"]: -(-r["n"] // BLOCK) for r in held.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
        blocks = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)) if sizes else F.create_map().cast("map<int,int>")
        # a cell's vectors are dealt to blocks, its queries go to each of them
        left = asked.withColumn("n", F.try_element_at(blocks, F.col("cell"))).where("n is not null").select("cell", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.lit(True).alias("asks"), "id", "vec")
        right = held.select("cell", F.pmod(F.xxhash64("id"), F.try_element_at(blocks, F.col("cell"))).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "vec")

        def product(table: pa.Table) -> pa.Table:
            asks = table.column("asks").to_numpy(zero_copy_only=False)
            ids = table.column("id").to_numpy()
            out: list[tuple[np.ndarray, ...]] = []
            if asks.any() and not asks.all():
                m = unit_rows(matrix(table.column("vec")))
                q, x = np.flatnonzero(asks), np.flatnonzero(~asks)
                for at in range(0, len(q), 1024):
                    part = q[at : at + 1024]
                    sims = m[part] @ m[x].T
                    sims[ids[part][:, None] == ids[x][None, :]] = -np.inf
                    i, j = keep(sims)
                    out.append((ids[part[i]], ids[x[j]], sims[i, j]))
            a, b, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            good = np.isfinite(s)
            return pa.table({"query": pa.array(a[good], pa.int64()), "id": pa.array(b[good], pa.int64()), "sim": pa.array(s[good], pa.float64())})

        return left.unionByName(right).groupBy("cell", "block").applyInArrow(product, "query bigint, id bigint, sim double")

    def search(self, queries: DataFrame, k: int = 1, probes: int | None = PROBES) -> DataFrame:
        """(query, id, sim, place): the k most similar stored vectors of each query (id, vec), itself left out; of equal
        ones the smaller id. probes None looks at all cells, which is exact."""

        def best(sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            n = min(k, sims.shape[1])
            level = np.partition(sims, sims.shape[1] - n, axis=1)[:, sims.shape[1] - n]
            return np.nonzero(sims >= level[:, None])

        near = self._compared(cut(queries.select(F.col("id").cast("bigint").alias("id"), "vec")), probes, best)
        order = Window.partitionBy("query").orderBy(F.col("sim").desc(), "id")
        return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def within(self, queries: DataFrame, threshold: float, probes: int | None = PROBES) -> DataFrame:
        """(query, id, sim): all stored vectors of the cells looked at that are at least so similar, itself left out."""
        return self._compared(cut(queries.select(F.col("id").cast("bigint").alias("id"), "vec")), probes, lambda sims: np.nonzero(sims >= threshold))
