"""Exact searches of 64-bit hashes within a small Hamming distance: joins, and a stored index.

A hash is cut into a fixed number of segments by position. Two hashes that differ in at most d bits agree on at
least (segments - d) whole segments, so every such pair shares a key built of that many segments and their
places. Joining on these keys and verifying the distance loses nothing, whatever the number of segments.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import cut

#: Keys of a batch that are sent to the workers at most (24 bytes each); larger batches are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: What a stored or shuffled key costs, in candidates that are compared.
KEY_COST = 8
#: An index is written anew with longer keys once it holds so many times the hashes that its keys were made for.
OUTGROWN = 8
#: Hashes of a task of close_pairs, about, and tasks at most.
TASK_HASHES, TASKS = 250_000, 10_000
#: Hashes of one group of close_pairs (a task holds them about five times, 8 bytes each): keys are lengthened beyond that,
#: as long as a hash has at most FIRST_KEYS.
HELD, FIRST_KEYS = 4_000_000, 500


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def layout(rows: int, max_distance: int, bits: int = 64) -> tuple[int, int]:
    """How many segments, and how many of them a key holds: the choice with the least cost of keys and candidates for a
    hash of so many bits among `rows` evenly spread ones. Keys lengthen with the logarithm of the rows, so candidates stay few."""
    cost = {}
    for agree in range(1, bits + 1 - max_distance):
        segments = max_distance + agree
        cost[agree] = comb(segments, agree) * (KEY_COST + rows / 2 ** (bits * agree / segments))
        if cost[agree] > 2 * min(cost.values()):
            break
    best = min(cost, key=lambda a: (cost[a], a))
    return max_distance + best, best


def masks(segments: int, agree: int, within: int = -1) -> list[int]:
    """The bits of each choice of segments, as signed numbers; the segments divide the bits of `within`, -1 are all."""
    places = [i for i in range(64) if within >> i & 1]
    cuts = [round(len(places) * i / segments) for i in range(segments + 1)]
    bits = [sum(1 << p for p in places[cuts[i] : cuts[i + 1]]) for i in range(segments)]
    every = [sum(bits[i] for i in chosen) for chosen in combinations(range(segments), agree)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in every]


def key_of(h: Column, mask: Column) -> Column:
    """The key of a hash for a choice of segments. Keys that collide only add candidates."""
    return F.xxhash64(mask, h.bitwiseAND(mask))


def keyed(df: DataFrame, h: str, segments: int, agree: int) -> DataFrame:
    """df with one row per key (column seg)."""
    return df.withColumn("_mask", F.explode(F.lit(masks(segments, agree)).cast("array<bigint>"))).withColumn("seg", key_of(F.col(h), F.col("_mask"))).drop("_mask")


def close_hashes(left: DataFrame, right: DataFrame, max_distance: int, rows: int) -> DataFrame:
    """Distinct pairs (a, b) of left.h and right.h that differ in at most max_distance bits.

    left and right: one row per hash, column h (bigint, not null). rows: about the size of the larger side; it only
    selects the keys, every choice gives the same result. Equal hashes are pairs as well.
    """
    kind = layout(rows, max_distance)
    a = keyed(left.select(F.col("h").alias("a")), "a", *kind)
    b = keyed(right.select(F.col("h").alias("b")), "b", *kind)
    if rows * comb(*kind) > BROADCAST_KEYS:
        b = b.hint("merge")  # Spark takes the keys for as few as the hashes, and would send them all through the driver
    return a.join(b, "seg").where(hamming(F.col("a"), F.col("b")) <= max_distance).select("a", "b").distinct()


def close_pairs(hashes: DataFrame, max_distance: int, rows: int) -> DataFrame:
    """Pairs (a, b) of different hashes that differ in at most max_distance bits, a < b, each pair once.

    hashes: one row per hash, column h (bigint, not null). rows: about their number, which selects keys and tasks only.
    A hash goes to a group for each of few short keys; inside its group it is compared by longer keys, in memory. A pair
    counts in the first group and under the first longer key that it shares, so no pair comes twice.
    """
    agree = 1
    while rows > HELD and comb(max_distance + agree + 1, agree + 1) <= FIRST_KEYS and _largest_group(hashes, masks(max_distance + agree, agree)) > HELD:
        agree += 1
    first = masks(max_distance + agree, agree)
    sent = hashes.select("h", F.posexplode(F.lit(first).cast("array<bigint>")).alias("at", "_mask"))
    tasks = max(1, min(TASKS, -(-rows * len(first) // TASK_HASHES)))
    dealt = sent.repartition(tasks, "at", F.col("h").bitwiseAND(F.col("_mask"))).select("at", "h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [(b.column("at").to_numpy(), b.column("h").to_numpy()) for b in batches]
        if not every:
            return
        at, h = (np.concatenate(x) for x in zip(*every, strict=True))
        del every
        found, n = [], 0
        for i in np.unique(at):
            for pair in _close_in_groups(h[at == i], first, int(i), max_distance):
                found.append(pair)
                n += len(pair[0])
                if n >= 100_000:
                    yield _batch(found)
                    found, n = [], 0
        if found:
            yield _batch(found)

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _largest_group(hashes: DataFrame, first: list[int]) -> int:
    keys = hashes.select("h", F.explode(F.lit(first).cast("array<bigint>")).alias("_mask"))
    return keys.groupBy("_mask", F.col("h").bitwiseAND(F.col("_mask"))).count().agg(F.max("count")).first()[0] or 0


def _batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (np.concatenate(z) for z in zip(*pairs, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _close_in_groups(h: np.ndarray, first: list[int], at: int, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs among hashes that agree on the bits first[at] and on those of no mask before it."""
    own = first[at]
    groups = np.sort(h & own)
    ends = np.flatnonzero(np.append(groups[1:] != groups[:-1], True))
    longest, free = int(np.diff(ends, prepend=-1).max()), 64 - (own & (1 << 64) - 1).bit_count()
    second = masks(*layout(longest, max_distance, free), within=~own) if free > max_distance else [0]
    for k, mask in enumerate(second):
        key = h & (own | mask)
        order = np.argsort(key)
        key, x = key[order], h[order]
        # pairs of equal key, by their distance in this order
        left, step = np.arange(len(x)), 1
        while True:
            left = left[: np.searchsorted(left, len(x) - step)]
            left = left[key[left] == key[left + step]]
            if not len(left):
                break
            differ = x[left] ^ x[left + step]
            near = np.flatnonzero(np.bitwise_count(differ.view(np.uint64)) <= max_distance)
            for before in (*first[:at], *second[:k]):
                near = near[differ[near] & before != 0]
            if len(near):
                yield x[left[near]], x[left[near] + step]
            step += 1


class SegmentIndex:
    """Accepted hashes by segment, kept in a folder: created once, opened by later sessions, probed by each batch
    and appended to under the batch's number.

    The folder holds `layout` (distance, keys, the hashes that they were made for, the generation) and one table per
    generation, divided by batch: (seg, h, no), no the smallest number accepted with the hash in that batch. An
    append replaces its own batch only, so a batch that is run again leaves what it left before. The keys are those
    of the stored layout, whoever opens it. A generation that was outgrown is written anew with longer keys; that
    happens each time the index has grown by OUTGROWN.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings

    @classmethod
    def create(cls, spark: SparkSession, folder: str, max_distance: int, rows: int = 100_000) -> SegmentIndex:
        """An empty index for about `rows` hashes; a folder that holds one already is refused (FileExistsError)."""
        if cls._read(spark, folder) is not None:
            raise FileExistsError(folder)
        segments, agree = layout(rows, max_distance)
        index = cls(spark, folder, {"distance": max_distance, "segments": segments, "agree": agree, "rows": rows, "generation": 0})
        index._write()
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SegmentIndex:
        """The index of a folder, with the keys that it was stored with; no history is read."""
        settings = cls._read(spark, folder)
        if settings is None:
            raise FileNotFoundError(folder)
        return cls(spark, folder, settings)

    @staticmethod
    def _read(spark: SparkSession, folder: str) -> dict | None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/layout")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        found = [json.loads(r[0]) for r in spark.read.text(f"{folder.rstrip('/')}/layout").collect()]
        return max(found, key=lambda x: x["generation"]) if found else None

    def _write(self) -> None:
        # one line per generation; the greatest counts
        self.spark.createDataFrame([(json.dumps(self.settings),)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/layout")

    @property
    def kind(self) -> tuple[int, int]:
        return self.settings["segments"], self.settings["agree"]

    @property
    def table(self) -> str:
        return f"{self.folder}/keys-{self.settings['generation']}"

    def rows(self) -> DataFrame:
        """(seg, h, no, batch) of all batches."""
        schema = "seg bigint, h bigint, no bigint, batch bigint"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.table)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.table)

    def hashes(self) -> DataFrame:
        """(h, no, batch), one row per hash and batch."""
        first = F.lit(masks(*self.kind)[0]).cast("bigint")
        return self.rows().where(F.col("seg") == key_of(F.col("h"), first)).select("h", "no", "batch").distinct()

    def append(self, accepted: DataFrame, batch: int | None = None) -> None:
        """Add accepted hashes (h, no; with batch None also the column batch, for many batches at a time). Rows with
        a null are left out; only the keys of these hashes are computed."""
        rows = accepted if batch is None else accepted.withColumn("batch", F.lit(batch).cast("bigint"))
        firsts = rows.where("h is not null and no is not null and batch is not null").groupBy("h", F.col("batch").cast("bigint").alias("batch")).agg(F.min("no").cast("bigint").alias("no"))
        out = keyed(firsts, "h", *self.kind).select("seg", "h", "no", "batch")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.table)
        if batch is not None and firsts.isEmpty():
            # dynamic overwrite leaves a batch alone that has no rows now
            self._forget(batch)

    def _forget(self, batch: int) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.table}/batch={batch}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def grow(self) -> bool:
        """Write the index anew with longer keys if it has outgrown its own; whether it did. The rows are counted from
        the files' footers, nothing is read before the index has outgrown its keys."""
        n = self.rows().count() // comb(*self.kind)
        fresh = layout(n, self.settings["distance"])
        if n < OUTGROWN * self.settings["rows"] or fresh == self.kind:
            return False
        held = self.hashes()
        grown = SegmentIndex(self.spark, self.folder, self.settings | {"segments": fresh[0], "agree": fresh[1], "rows": n, "generation": self.settings["generation"] + 1})
        grown.append(held)
        grown._write()  # only now is the new generation the one that is opened
        self.settings = grown.settings
        return True

    def probe(self, batch: DataFrame, before: int | None = None) -> DataFrame:
        """(h, no, held, held_no): hashes of the batch (h, no) and the accepted ones close to them whose number is
        smaller than their own, each pair once. before: only what was appended under smaller batch numbers counts.

        The keys of the batch go to the stored ones if they are at most BROADCAST_KEYS, so the index is scanned but
        not moved, and stored hashes never meet each other.
        """
        batch = cut(batch.select("h", "no").where("h is not null and no is not null"))
        keys = keyed(batch, "h", *self.kind)
        small = batch.count() * comb(*self.kind) <= BROADCAST_KEYS
        held = self.rows() if before is None else self.rows().where(F.col("batch") < before)
        held = held.select("seg", F.col("h").alias("held"), F.col("no").alias("held_no"))
        near = held.join(F.broadcast(keys) if small else keys, "seg")
        return near.where((hamming(F.col("h"), F.col("held")) <= self.settings["distance"]) & (F.col("held_no") < F.col("no"))).select("h", "no", "held", "held_no").distinct()
