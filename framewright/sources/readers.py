"""Sources: file listings, annotation tables, split lists, frames, vectors, sweep results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.mixture import per_class_quota
from framewright.schema import SWEEP_SCHEMA, VECTOR_SCHEMA

#: Extensions of clips.
EXTENSIONS = ["mp4", "avi", "mov", "mkv"]
ANNOTATIONS = "label STRING, youtube_id STRING, time_start INT, time_end INT, split STRING"
FRAMES = "path STRING, frame_idx INT, h INT, w INT, c INT, pixels BINARY"


def list_clips(spark: SparkSession, folder: str, extensions: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(path, size, modified) of clip files below a folder, in lower or upper case spelling; contents are not read.
    With limit the first by path."""
    names = sorted({x for e in (EXTENSIONS if extensions is None else extensions) for x in (e.lower().lstrip("."), e.upper().lstrip("."))})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(names)}}}").load(folder)
    listed = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return listed if limit is None else listed.orderBy("path").limit(limit)


def existing(clips: DataFrame, listing: DataFrame, key: str = "path") -> DataFrame:
    """Clips whose file is in the listing."""
    return clips.join(listing.select(F.col("path").alias(key)), key, "left_semi")


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, md5) of the contents of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", F.md5("content").alias("md5"))


def read_annotations(spark: SparkSession, path: str, split: str | None = None, classes: list[str] | None = None, quota: int | None = None) -> DataFrame:
    """(youtube_id, time_start, time_end, label, split) of CSV files with a header; the first `quota` rows of each class
    in file order: by file, by block of the file, and within a block by pos."""
    rows = spark.read.option("header", "true").option("enforceSchema", "false").csv(path)
    wanted = [f.split() for f in ANNOTATIONS.split(", ")]
    typed = rows.select(*(F.col(n).cast(k).alias(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in wanted), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("pos", F.monotonically_increasing_id())
    typed = typed if split is None else typed.withColumn("split", F.lit(split))
    typed = typed if classes is None else typed.where(F.col("label").isin(classes))
    return typed if quota is None else per_class_quota(typed, "label", ["file", "block", "pos"], quota)


def read_split_list(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """(rel_path, label) of text lines 'Class/file.avi N'; blank lines are skipped."""
    first = F.element_at(F.split(F.trim("value"), r"\s+"), 1)
    rows = spark.read.text(path).where(F.trim("value") != "").select(first.alias("rel_path"), F.element_at(F.split(first, "/"), 1).alias("label"))
    return rows if classes is None else rows.where(F.col("label").isin(classes))


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SWEEP_SCHEMA).option("header", "true").csv(path)


def read_vectors(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """A vector table; with size, rows of another length are left out."""
    rows = spark.read.schema(VECTOR_SCHEMA).parquet(path)
    return rows if size is None else rows.where(F.size("vector") == size)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def label_map(clips: DataFrame, label: str = "label") -> dict[str, int]:
    """Label -> its place among the sorted labels of these clips."""
    from framewright.operators.mixture import label_numbers

    return {r["label"]: r["label_idx"] for r in label_numbers(clips, label).collect()}


def training_batches(clips: DataFrame, columns: list[str], split: str | None = None, batch_size: int = 32, labels: dict[str, int] | None = None, drop_last: bool = False) -> Iterator[pa.RecordBatch]:
    """Record batches of `batch_size` clips of a split for a training loop: the columns, and `label_number` from
    `labels` (label_map; a label that it lacks has the clip's label_idx, or -1).

    The rows are streamed partition by partition as Arrow batches, so the driver holds one partition at most; mix and
    shuffle beforehand (mixture.mix_to_total, an order by shuffle_key).
    """
    kept = clips if split is None else clips.where(F.col("split") == split)
    if labels is not None:
        own = F.coalesce(F.col("label_idx"), F.lit(-1)) if "label_idx" in clips.columns else F.lit(-1)
        numbers = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair)) if labels else None
        number = own if numbers is None else F.coalesce(F.try_element_at(numbers, F.col("label")), own)
        kept = kept.withColumn("label_number", number.cast("int"))
    kept = kept.select(*columns, *(["label_number"] if labels is not None else []))
    packed = kept.mapInArrow(_packed, "chunk binary")
    held: list[pa.RecordBatch] = []
    rows = 0
    for chunk in packed.toLocalIterator(prefetchPartitions=True):
        with pa.ipc.open_stream(bytes(chunk["chunk"])) as reader:
            for batch in reader:
                held.append(batch)
                rows += len(batch)
        if rows >= batch_size:
            table = pa.Table.from_batches(held).combine_chunks()
            whole = rows - rows % batch_size
            for at in range(0, whole, batch_size):
                yield table.slice(at, batch_size).combine_chunks().to_batches()[0]
            held, rows = table.slice(whole).to_batches(), rows - whole
    if rows and not drop_last:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row of Arrow's stream format."""
    for batch in batches:
        if len(batch):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk"])
