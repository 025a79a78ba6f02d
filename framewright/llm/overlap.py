"""Problem 2: records of evaluation splits that appear, equal or nearly so, in the training split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.clean import file_name, hash64, split_key
from framewright.operators.distribute import join_unique
from framewright.operators.segments import close_hashes, hamming
from framewright.session import cut

MAX_DISTANCE = 6


def split_hashes(clips: DataFrame) -> DataFrame:
    """Distinct (path, side, h): side is train or eval; rows without split, path or hash take no part."""
    split = split_key(F.col("split"))
    side = F.when(split == "train", "train").when(split.isNotNull(), "eval")
    return (
        clips.select("path", side.alias("side"), hash64(F.col("phash")).alias("h"))
        .where(F.col("path").isNotNull() & F.col("side").isNotNull() & F.col("h").isNotNull())
        .distinct()
    )


def close_sides(rows: DataFrame, max_distance: int) -> DataFrame:
    """(a, b): each evaluation hash and the training hashes close to it. Each hash enters once, however often."""
    sides = cut(rows.groupBy("h").agg(F.max(F.col("side") == "train").alias("t"), F.max(F.col("side") == "eval").alias("e")))
    return cut(close_hashes(sides.where("e"), sides.where("t"), max_distance, sides.count()))


def cross_split_pairs(clips: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Every (train_path, eval_path) whose hashes differ in at most max_distance bits.

    clips: path, split, phash; other columns are ignored, whatever their names. Hashes are compared once each; their
    paths meet afterwards. A hash that holds a large part of both sides has as many pairs as the product of its
    paths, which is what is asked for here; coverage() and record_coverage() list no pairs. Nulls in any of the columns
    take a row out; an empty table gives an empty result; repeated rows and ties change nothing. A path that stands
    in both splits is not paired with itself.
    """
    rows = cut(split_hashes(clips))
    near = close_sides(rows, max_distance)
    members = lambda side, h, name: rows.where(F.col("side") == side).select(F.col("h").alias(h), F.col("path").alias(name))
    return (
        near.join(members("eval", "a", "eval_path"), "a")
        .join(members("train", "b", "train_path"), "b")
        .where("eval_path <> train_path")
        .select("train_path", "eval_path")
        .distinct()
    )


def found(clips: DataFrame) -> DataFrame:
    """Pairs (path_a, path_b), path_a < path_b, each once."""
    pairs = cross_split_pairs(clips)
    return pairs.select(F.least("train_path", "eval_path").alias("path_a"), F.greatest("train_path", "eval_path").alias("path_b")).distinct()


def record_coverage(clips: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(path, train_hashes, least_distance, coverage) of each evaluation path that overlaps with train: how many
    training hashes are close to one of its own, the least distance, and the share of equal bits at that distance.

    A hash counts only if a training path other than the path itself has it; for that the least and the greatest of
    its paths are enough, so nothing grows with the copies of a hash.
    """
    rows = cut(split_hashes(clips))
    train = rows.where("side = 'train'").groupBy("h").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    near = cut(close_sides(rows, max_distance).join(train.withColumnRenamed("h", "b"), "b").select("a", "lo", "hi", hamming(F.col("a"), F.col("b")).alias("d")))
    evals = cut(rows.where("side = 'eval'").select("path", F.col("h").alias("a")))
    both = evals.join(rows.where("side = 'train'").select("path").distinct(), "path", "left_semi")
    counts = [F.count("*").alias("n"), F.min("d").alias("d")]
    plain = join_unique(evals.join(both.select("path").distinct(), "path", "left_anti"), near.groupBy("a").agg(*counts), "a", "inner")
    # paths of both splits look at each partner, as one may be their own
    special = both.join(near, "a").where("lo <> path or hi <> path").groupBy("path", "a").agg(*counts)
    per = plain.select("path", "n", "d").unionByName(special.select("path", "n", "d")).groupBy("path").agg(F.sum("n").alias("train_hashes"), F.min("d").alias("least_distance"))
    return per.withColumn("coverage", F.round(1 - F.col("least_distance") / 64, 6))


def coverage(clips: DataFrame) -> DataFrame:
    """Per evaluation split and source file: clips, clips that overlap with train, their share.

    Clips without a source file are reported under a null source.
    """
    hit = record_coverage(clips).select("path", F.lit(1).alias("hit"))
    evals = clips.select("path", split_key(F.col("split")).alias("split"), file_name(F.col("source_path")).alias("source_file"))
    evals = evals.where(F.col("split").isin("val", "test") & F.col("path").isNotNull()).distinct()
    joined = evals.join(hit, "path", "left")
    return joined.groupBy("split", "source_file").agg(
        F.countDistinct("path").alias("clips"), F.countDistinct(F.when(F.col("hit") == 1, F.col("path"))).alias("overlapping")
    ).withColumn("share", F.round(F.col("overlapping") / F.col("clips"), 6))
