"""Problem 6: a score cutoff per label that keeps a target fraction, exact, by bracketing with summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.clean import label_key, usable_score
from framewright.llm.summaries import brackets, merged
from framewright.operators.distribute import hot_keys, join_unique, prefix_sum
from framewright.session import cut

#: Ranks of a summary are known to this share of the rows: a bracket holds at most about four times as many of a
#: label's rows, more only where values are equal.
ERROR = 0.002


def latest_scored(clips: DataFrame) -> DataFrame:
    """(path, key, score) of the latest row of each path, where it has a label and a usable blur_score."""
    newest = clips.where("path is not null").groupBy("path").agg(F.max(F.struct("ingested_at", "label", "blur_score")).alias("r"))
    # -0.0 and 0.0 are one value
    scored = newest.select("path", label_key(F.col("r.label")).alias("key"), (usable_score(F.col("r.blur_score")) + 0.0).alias("score"))
    return scored.where("key is not null and score is not null")


def _cutoffs(scored: DataFrame, targets: DataFrame) -> DataFrame:
    asked = targets.select(label_key(F.col("label")).alias("key"), "keep_pct").where("key is not null and keep_pct is not null").groupBy("key").agg(F.max("keep_pct").alias("keep_pct"))
    # counts are few rows; scored clips meet tables of a row a label by join_unique, as one label may hold most clips
    counts = cut(scored.groupBy("key").agg(F.count("*").alias("n")))
    hot = hot_keys(counts, "key", "n")
    plan = cut(counts.join(asked, "key").withColumn("k", F.expr("(keep_pct * n + 99) div 100")))
    inside = plan.where("k >= 1 and k <= n")
    mine = join_unique(scored, plan.select("key"), "key", "inner", hot)
    bracket = cut(brackets(merged(mine, ["key"], "score", ERROR), "key", inside.select("key", F.expr("n - k + 1").alias("rank"))))
    held = join_unique(mine, bracket, "key", "inner", hot)
    above = held.where("score > high").groupBy("key").agg(F.count("*").alias("above"))
    values = held.where("score between low and high").groupBy("key", "score").agg(F.count("*").alias("w"))
    summed = prefix_sum(values, [F.col("key"), F.col("score").desc()], "w", "upto")
    first = summed.groupBy("key").agg(F.min(F.col("upto") - F.col("w")).alias("r0"))
    counted_down = summed.join(first, "key").join(above, "key", "left").join(inside.select("key", "k"), "key")
    reached = counted_down.withColumn("kept", F.coalesce("above", F.lit(0)) + F.col("upto") - F.col("r0")).where("kept >= k")
    cutoff = reached.groupBy("key").agg(F.max("score").alias("cutoff"), F.min("kept").alias("kept"))
    # k beyond n keeps all, k of 0 keeps none
    return plan.join(cutoff, "key", "left").withColumn("kept", F.coalesce("kept", F.when(F.col("k") > F.col("n"), F.col("n")), F.lit(0)))


def cutoffs(clips: DataFrame, targets: DataFrame) -> DataFrame:
    """key, n, k, cutoff, kept for each label of targets that has scored clips.

    n scored clips, k = keep_pct * n / 100 rounded up, cutoff = the k-th greatest score, kept = clips at or
    above it (more than k where scores tie). Labels are compared by label_key. Only values inside a label's
    bracket are sorted, by range partitions, with equal values counted before; no label is one task.
    """
    return _cutoffs(cut(latest_scored(clips)), targets).select("key", "n", "k", "cutoff", F.col("kept").cast("bigint").alias("kept"))


def found(clips: DataFrame, targets: DataFrame) -> DataFrame:
    """path of the clips below their label's cutoff; each once."""
    scored = cut(latest_scored(clips))
    limit = cut(_cutoffs(scored, targets).select("key", "k", "cutoff"))
    return join_unique(scored, limit, "key", "inner").where("score < cutoff or k < 1").select("path")
