"""Problem 7: percentiles of large numeric columns per group, by mergeable rank-interval summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.clean import label_key, usable_score
from framewright.llm.summaries import merge_groups, quantiles, summarize

#: The stated error is at most RANK_ERROR of a group's rows: summaries that know less are refused. Parts of it that
#: a partition, the two levels of merging a day, and the two levels of merging days may use.
RANK_ERROR = 0.002
SHARES = (0.125, 0.25, 0.35, 0.5, 1.0)
PERCENTS = [1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 90.0, 95.0, 99.0]
METRICS = ["blur_score", "motion_score"]


def scored(clips: DataFrame) -> DataFrame:
    """label, day, metric, value of every usable score."""
    long = clips.select(label_key(F.col("label")).alias("label"), F.to_date("ingested_at").alias("day"), F.explode(F.array(
        *(F.struct(F.lit(m).alias("metric"), usable_score(F.col(m)).alias("value")) for m in METRICS)
    )).alias("x"))
    return long.where("label is not null and x.value is not null").select("label", "day", "x.metric", "x.value")


def daily_summaries(clips: DataFrame, error: float = RANK_ERROR) -> DataFrame:
    """label, day, metric, v, lo, hi, under: a summary per label (label_key), day of ingested_at and metric.

    This is the stored form: rows of further days are appended, and any selection of days is merged by
    percentiles(). Null, NaN and negative scores and null labels are left out; a null ingested_at is a day of
    its own. All rows count, repeated ones as well. Empty tables give no rows.
    """
    keys = ["label", "day", "metric"]
    dated = scored(clips).withColumn("day", F.col("day").cast("string"))
    merged = merge_groups(summarize(dated, keys, "value", SHARES[0] * error), keys, SHARES[1] * error, SHARES[2] * error)
    return merged.withColumn("day", F.col("day").cast("date"))


def percentiles(daily: DataFrame, percents: list[float] = PERCENTS, error: float = RANK_ERROR) -> DataFrame:
    """label, metric, percent, n, value, rank_error over all days of `daily` (select days beforehand).

    value is one of the group's values, at a rank within rank_error of max(1, ceil(percent / 100 * n)); rank_error is
    at most `error` of n, or ValueError is raised. Days may have been summarised apart, with the same error.
    """
    keys = ["label", "metric"]
    return quantiles(merge_groups(daily.drop("day"), keys, SHARES[3] * error, SHARES[4] * error), keys, percents, error)


def within_error(clips: DataFrame) -> DataFrame:
    """label, metric, percent, n, rank, within: whether the exact ranks of the answered value reach to within its
    stated error of the asked rank, and that error is within RANK_ERROR. The answers are a few rows a label."""
    answers = percentiles(daily_summaries(clips)).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("percent") * F.col("n") / 100, 9))).cast("bigint"))
    asked = answers.groupBy("label", "metric").agg(F.collect_list(F.struct("percent", "n", "rank", "value", "rank_error")).alias("asked"))
    values = scored(clips).groupBy("label", "metric", "value").agg(F.count("*").alias("w"))
    held = values.join(F.broadcast(asked), ["label", "metric"])  # labels x metrics rows
    each = held.select("label", "metric", F.col("value").alias("v"), "w", F.explode("asked").alias("a"))
    counts = each.groupBy("label", "metric", "a").agg(F.sum(F.when(F.col("v") < F.col("a.value"), F.col("w")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("a.value"), F.col("w")).otherwise(0)).alias("upto"))
    rank, error = F.col("a.rank"), F.col("a.rank_error")
    within = (F.col("below") + 1 - error <= rank) & (rank <= F.col("upto") + error) & (error <= RANK_ERROR * F.col("a.n") + 1)
    return counts.select("label", "metric", F.col("a.percent").alias("percent"), F.col("a.n").alias("n"), rank.alias("rank"), within.alias("within"))
