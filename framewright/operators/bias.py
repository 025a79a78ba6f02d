"""What score gates do to class balance: distributions, drift, retention, sweeps, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")
#: Fixed value: the upper bound of motion where none is given.
MOTION_MAX = 1e9


def blur_gate(threshold: float | Column, score: str = "blur_score") -> Column:
    """A threshold of zero or less passes all; otherwise the score must reach it. A missing score passes."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return (t <= 0) | (F.coalesce(F.col(score).cast("double"), F.lit(INF)) >= t)


def motion_gate(low: float, high: float = MOTION_MAX, score: str = "motion_score") -> Column:
    """low <= score <= high, both inclusive; a missing score counts as low."""
    return F.coalesce(F.col(score).cast("double"), F.lit(float(low))).between(float(low), float(high))


def class_distribution(clips: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, fraction) of each class; no clips give no rows. The total is a window over the class counts."""
    counts = clips.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def representation_drift(baseline: DataFrame, filtered: DataFrame) -> DataFrame:
    """(label, drift) = (filtered - baseline) / baseline for the baseline's classes; a class that is gone has -1,
    a baseline of zero has 0, classes that only the filtered side has are left out."""
    f = filtered.select("label", F.col("fraction").alias("f"))
    b = baseline.select("label", F.col("fraction").alias("b"))
    share = F.coalesce("f", F.lit(0.0))
    return b.join(f, b["label"].eqNullSafe(f["label"]), "left").select(b["label"], F.when(F.col("b") == 0, 0.0).otherwise((share - F.col("b")) / F.col("b")).alias("drift"))


def total_variation(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row (tvd): half the sum of |p - q| over the classes of both."""
    both = p.select("label", F.col("fraction").alias("x")).unionByName(q.select("label", (-F.col("fraction")).alias("x")))
    return both.groupBy("label").agg(F.sum("x").alias("d")).agg((F.coalesce(F.sum(F.abs("d")), F.lit(0.0)) / 2).alias("tvd"))


def retention(clips: DataFrame, passes: Column, label: str = "label") -> DataFrame:
    """(label, n_before, n_after, retention_rate) by class; a class without clips would be NaN and has no row."""
    counts = clips.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_before"), F.count_if(passes).alias("n_after"))
    return counts.withColumn("retention_rate", F.col("n_after") / F.col("n_before"))


def retention_of(clips: DataFrame, passes: Column, label: str | None = None, column: str = "label") -> DataFrame:
    """One row (retention_rate): of all clips or of one class; NaN without clips."""
    base = clips if label is None else clips.where(F.col(column) == label)
    return base.agg(F.coalesce(F.count_if(passes) / F.nullif(F.count("*"), F.lit(0)), F.lit(float("nan"))).alias("retention_rate"))


def threshold_sweep(clips: DataFrame, thresholds: list[float], label: str = "label", score: str = "blur_score", motion_min: float = 0.0, motion: str | None = None) -> DataFrame:
    """One row per threshold and class: what is left of the class, how its share drifts, and the whole's TVD.

    One scan and one aggregation by class: a conditional count per threshold, unpivoted afterwards, so neither
    clips nor thresholds are multiplied. motion_min > 0 adds the motion gate, if `motion` names a column.
    """
    passes = [blur_gate(float(t), score) & (motion_gate(motion_min, score=motion) if motion and motion_min > 0 else F.lit(True)) for t in thresholds]
    wide = clips.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n_clips_before"), *(F.count_if(p).alias(f"t{i}") for i, p in enumerate(passes)))
    pairs = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n_clips_after")) for i, t in enumerate(thresholds))))
    long = wide.select("class", "n_clips_before", pairs.alias("x")).select("x.threshold", "class", "n_clips_before", "x.n_clips_after")
    return _sweep_columns(long)


def threshold_sweep_table(clips: DataFrame, thresholds: DataFrame, label: str = "label", score: str = "blur_score") -> DataFrame:
    """The same for thresholds that come from a table (threshold): clips are first reduced to one histogram row
    per class and step of the sorted thresholds, so the thresholds are joined to classes, never to clips."""
    levels = thresholds.select(F.col("threshold").cast("double")).where("threshold is not null").distinct()
    steps = levels.agg(F.sort_array(F.collect_set("threshold")).alias("ts"))
    value = F.coalesce(F.col(score).cast("double"), F.lit(INF))
    reached = clips.crossJoin(F.broadcast(steps)).select(F.col(label).alias("class"), F.size(F.filter("ts", lambda t: (t <= 0) | (value >= t))).alias("reached"))
    hist = reached.groupBy("class", "reached").agg(F.count("*").alias("n"))
    ranked = levels.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("threshold")))
    per_class = hist.groupBy("class").agg(F.sum("n").alias("n_clips_before"))
    grid = per_class.crossJoin(F.broadcast(ranked))
    passed = grid.join(hist, "class").groupBy("threshold", "class", "n_clips_before").agg(F.sum(F.when(F.col("reached") >= F.col("at"), F.col("n")).otherwise(0)).alias("n_clips_after"))
    return _sweep_columns(passed)


def _sweep_columns(long: DataFrame) -> DataFrame:
    every = Window.partitionBy("threshold")
    before, after = F.sum("n_clips_before").over(every), F.sum("n_clips_after").over(every)
    base, now = F.col("n_clips_before") / before, F.coalesce(F.col("n_clips_after") / F.nullif(after, F.lit(0)), F.lit(0.0))
    with_shares = long.withColumns({"base": base, "now": now, "overall_retention": after / before})
    return with_shares.select(
        "threshold", "class", (F.col("n_clips_after") / F.col("n_clips_before")).alias("retention_rate"), ((F.col("now") - F.col("base")) / F.col("base")).alias("drift"),
        "n_clips_before", "n_clips_after", "overall_retention", (F.sum(F.abs(F.col("now") - F.col("base"))).over(every) / 2).alias("tvd"),
    )


def at_risk_by_drift(sweep: DataFrame, threshold: float, min_drift: float = -0.5) -> DataFrame:
    """Classes whose drift at exactly this threshold is below min_drift."""
    return sweep.where((F.col("threshold") == threshold) & (F.col("drift") < min_drift)).select("class")


def at_risk_by_retention(sweep: DataFrame, threshold: float, cutoff: float = 0.5) -> DataFrame:
    """Classes of which less than the cutoff is kept at exactly this threshold."""
    return sweep.where((F.col("threshold") == threshold) & (F.col("retention_rate") < cutoff)).select("class")


def recovery(real: DataFrame, synthetic: DataFrame, threshold: float, label: str = "label", score: str = "blur_score") -> DataFrame:
    """(class, real_fraction, real_synth_fraction, delta): shares of the gated real clips, and of those together
    with all synthetic clips, which pass no gate. Classes of either side; the missing share is 0."""
    kept = real.where(blur_gate(threshold, score)).select(F.col(label).alias("class"), F.lit(1).alias("r"))
    both = kept.unionByName(synthetic.select(F.col(label).alias("class"), F.lit(0).alias("r")))
    counts = both.groupBy("class").agg(F.sum("r").alias("r"), F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(0))
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.sum(c).over(whole), F.lit(0)), F.lit(0.0))
    out = counts.select("class", share("r").alias("real_fraction"), share("n").alias("real_synth_fraction"))
    return out.withColumn("delta", F.col("real_synth_fraction") - F.col("real_fraction"))


def most_variable_classes(sweep: DataFrame, n: int) -> DataFrame:
    """(class, spread): the n classes whose retention varies most over the thresholds (sample deviation)."""
    return sweep.groupBy("class").agg(F.stddev_samp("retention_rate").alias("spread")).orderBy(F.col("spread").desc_nulls_last(), "class").limit(n)


def tvd_by_threshold(sweep: DataFrame) -> DataFrame:
    """(threshold, tvd): constant within a threshold."""
    return sweep.groupBy("threshold").agg(F.min("tvd").alias("tvd"))


def pipeline_stats(clips: DataFrame) -> DataFrame:
    """One row: total, n_classes, mean_blur, mean_motion and the class counts as a map; no row without clips."""
    per = clips.groupBy("label").agg(F.count("*").alias("n"), F.sum("blur_score").alias("b"), F.count("blur_score").alias("nb"), F.sum("motion_score").alias("m"), F.count("motion_score").alias("nm"))
    return per.agg(
        F.sum("n").alias("total"), F.count_if(F.col("label").isNotNull()).alias("n_classes"), (F.sum("b") / F.nullif(F.sum("nb"), F.lit(0))).alias("mean_blur"),
        (F.sum("m") / F.nullif(F.sum("nm"), F.lit(0))).alias("mean_motion"), F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))).alias("class_counts"),
    ).where("total is not null")


def motion_bins(clips: DataFrame, keep: Column, edges: list[float], score: str = "motion_score") -> DataFrame:
    """(bin_low, bin_high, n, kept, keep_rate) of left-closed bins; values outside have a null bin."""
    low = F.lit(None).cast("double")
    for a, b in zip(edges, edges[1:], strict=False):
        low = F.when((F.col(score) >= a) & (F.col(score) < b), float(a)).otherwise(low)
    high = F.lit(None).cast("double")
    for a, b in zip(edges, edges[1:], strict=False):
        high = F.when(F.col("bin_low") == float(a), float(b)).otherwise(high)
    counts = clips.select(low.alias("bin_low"), keep.alias("k")).groupBy("bin_low").agg(F.count("*").alias("n"), F.count_if("k").alias("kept"))
    return counts.select("bin_low", high.alias("bin_high"), "n", "kept", (F.col("kept") / F.col("n")).alias("keep_rate"))
