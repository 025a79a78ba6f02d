"""Streams of manifests: incremental dedup against a kept index, and windowed statistics of arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from framewright.operators.dedup import dedup_by_hash
from framewright.operators.segments import SegmentIndex
from framewright.session import cut


def accept_batch(batch: DataFrame, batch_id: int, index: str, threshold: int) -> DataFrame:
    """The batch's clips that are no near-duplicate of kept ones or of earlier clips of the batch. They are written
    to <index>/clips and their hashes to the segment index in <index>/hashes, both under the batch's number, so a
    repeated batch replaces its own rows. Kept clips are probed by the batch, never compared with each other.

    batch: ord (unique over all batches), hs (array<bigint>), further columns. Late clips count as later.
    """
    spark = batch.sparkSession
    fresh = cut(batch.dropDuplicates(["ord"]))
    try:
        held = SegmentIndex.open(spark, f"{index}/hashes")
    except FileNotFoundError:
        held = SegmentIndex.create(spark, f"{index}/hashes", threshold)
    if held.settings["distance"] != threshold:
        raise ValueError(f"the index was made for distance {held.settings['distance']}")
    own = cut(fresh.select("ord", F.explode("hs").alias("h")).where("h is not null").distinct())
    # whatever was kept by batches before counts, so the numbers of the probe are above all others
    asked = own.select("h").distinct().withColumn("no", F.lit((1 << 63) - 1))
    seen = held.probe(asked, before=batch_id).select("h").distinct()
    unseen = cut(fresh.join(own.join(seen, "h", "left_semi").select("ord"), "ord", "left_anti"))
    accepted = cut(dedup_by_hash(unseen, threshold).where(~F.col("is_duplicate")).select(*batch.columns))
    accepted.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{index}/clips")
    held.append(accepted.select(F.explode("hs").alias("h"), F.col("ord").alias("no")), batch_id)
    held.grow()
    return accepted


def dedup_stream(stream: DataFrame, index: str, checkpoint: str, threshold: int = 10, available_now: bool = True) -> StreamingQuery:
    """Run accept_batch on every micro-batch of a stream of clips."""
    writer = stream.writeStream.foreachBatch(lambda df, i: accept_batch(df, i, index, threshold) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def arrival_stats(stream: DataFrame, time: str, value: str, window: str = "1 hour", late: str = "10 minutes", by: str = "label") -> DataFrame:
    """(window_start, by, n, mean): tumbling windows; rows later than the watermark are dropped. Works on
    batches as well, where nothing is late."""
    timed = stream.withWatermark(time, late) if stream.isStreaming else stream
    per = timed.groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return per.select(F.col("window.start").alias("window_start"), by, "n", "mean")


def manifest_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the JSON Lines manifests that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)
