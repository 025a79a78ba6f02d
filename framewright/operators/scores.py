"""From frame values to clip scores and gates: quality, motion, scenes, captions, annotation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the gates.
BLUR_THRESHOLD, QUALITY_THRESHOLD = 40.0, 50.0
MIN_MOTION, MAX_MOTION = 2.0, 80.0
AGGREGATES = ["mean", "min", "median"]


def uniform_indices(total: Column, n: int, all_if_short: bool = False) -> Column:
    """Frame numbers int(i * total / n) for i < n; with all_if_short every frame of clips shorter than n."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * total / n).cast("int"))
    if not all_if_short:
        return spread
    every = F.when(total > 0, F.sequence(F.lit(0), (total - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(total < n, every).otherwise(spread)


def linspace_indices(total: Column, n: int) -> Column:
    """Frame numbers int(i * (total - 1) / (n - 1)): first and last frame included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (total - 1) / max(n - 1, 1)).cast("int"))


def strided_indices(total: Column, native_fps: Column, target_fps: float, n: int) -> Column:
    """Every stride-th frame to reach about target_fps, then n of them evenly; stride is rounded half to even."""
    stride = F.greatest(F.lit(1), F.bround(native_fps / target_fps).cast("int"))
    kept = F.ceil(total / stride).cast("int")
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.floor(i * kept / n) * stride).cast("int"))
    short = F.transform(F.sequence(F.lit(0), F.greatest(kept - 1, F.lit(0))), lambda i: (i * stride).cast("int"))
    return F.when(kept <= n, short).otherwise(picked)


def duration(fps: Column, frames: Column) -> Column:
    """Seconds; an fps of zero or null counts as 30, unknown frames as a clip of 10 seconds."""
    return F.coalesce(frames / F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(30.0)), F.lit(10.0))


def number_frames(frames: DataFrame, clip: str, *order: str) -> DataFrame:
    """frames with frame_idx (from 0 within the clip) and total."""
    own = Window.partitionBy(clip)
    return frames.withColumn("frame_idx", F.row_number().over(own.orderBy(*order)) - 1).withColumn("total", F.count("*").over(own))


def aggregate_of(name: str, value: Column) -> Column:
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {name}")
    return {"mean": F.avg, "min": F.min, "median": F.median}[name](value)


def quality_scores(frames: DataFrame, clip: str = "path", agg: str = "mean", blur_threshold: float = BLUR_THRESHOLD, quality_threshold: float = QUALITY_THRESHOLD, frames_blur: int = 8, frames_quality: int = 4) -> DataFrame:
    """(clip, blur_score, quality_score, is_blurry, is_low_quality, passed, n_frames_sampled).

    frames: clip, frame_idx (0-based place in the sample), blur, quality. Blur is aggregated over the first
    frames_blur frames of the sample, quality over the first frames_quality; a clip whose frames have no
    values scores 0 and 100 and fails. One aggregation, one shuffle.
    """
    per = frames.groupBy(clip).agg(
        aggregate_of(agg, F.when(F.col("frame_idx") < frames_blur, F.col("blur"))).alias("b"),
        aggregate_of(agg, F.when(F.col("frame_idx") < frames_quality, F.col("quality"))).alias("q"),
        F.count_if((F.col("frame_idx") < frames_blur) & F.col("blur").isNotNull()).cast("int").alias("n_frames_sampled"),
    )
    empty = F.col("n_frames_sampled") == 0
    blurry = empty | (F.lit(blur_threshold > 0) & (F.col("b") < blur_threshold))
    low = empty | (F.col("q") > quality_threshold)
    return per.select(clip, F.coalesce("b", F.lit(0.0)).alias("blur_score"), F.coalesce("q", F.lit(100.0)).alias("quality_score"), blurry.alias("is_blurry"), low.alias("is_low_quality"), (~blurry & ~low).alias("passed"), "n_frames_sampled")


def with_flags(scores: DataFrame, blur_threshold: float, quality_threshold: float) -> DataFrame:
    """scores (blur_score, quality_score) with the three flags for other thresholds."""
    blurry = F.lit(blur_threshold > 0) & (F.col("blur_score") < blur_threshold)
    low = F.col("quality_score") > quality_threshold
    return scores.withColumns({"is_blurry": blurry, "is_low_quality": low, "passed": ~blurry & ~low})


def frame_pairs(frames: DataFrame, clip: str, value: str, n_pairs: int = 6) -> DataFrame:
    """(clip, start, a, b): values of the frames start and start + 1, start = i * step for i < n_pairs,
    step = max(1, (total - 1) div n_pairs); pairs without a second frame are left out.

    frames: clip, frame_idx, total, value. Consecutive frames meet by a window in the clip's own partition.
    """
    following = F.lead(value).over(Window.partitionBy(clip).orderBy("frame_idx"))
    step = F.greatest(F.lit(1), F.floor((F.col("total") - 1) / n_pairs)).cast("int")
    pairs = frames.withColumns({"_b": following, "_step": step})
    return pairs.where((F.col("frame_idx") % F.col("_step") == 0) & (F.col("frame_idx") / F.col("_step") < n_pairs) & F.col("_b").isNotNull()).select(clip, F.col("frame_idx").alias("start"), F.col(value).alias("a"), F.col("_b").alias("b"))


def motion_scores(magnitudes: DataFrame, clips: DataFrame | None = None, clip: str = "path", low: float = MIN_MOTION, high: float = MAX_MOTION) -> DataFrame:
    """Mean, 95th percentile (max_flow_magnitude), population deviation (motion_uniformity) of flow magnitudes.

    magnitudes: clip, magnitude. static below low, shaky above high, passed between (both inclusive). With
    clips, those without any pair have zeros and are static and failed.
    """
    m = F.col("magnitude")
    per = magnitudes.groupBy(clip).agg(F.avg(m).alias("mean_flow_magnitude"), F.percentile(m, F.lit(0.95)).alias("max_flow_magnitude"), F.stddev_pop(m).alias("motion_uniformity"), F.count(m).cast("int").alias("n_pairs_sampled"))
    if clips is not None:
        per = clips.select(clip).distinct().join(per, clip, "left").na.fill(0.0, ["mean_flow_magnitude", "max_flow_magnitude", "motion_uniformity"]).na.fill(0, ["n_pairs_sampled"])
    mean, none = F.col("mean_flow_magnitude"), F.col("n_pairs_sampled") == 0
    return per.withColumns({"is_static": none | (mean < low), "is_shaky": ~none & (mean > high), "passed": ~none & (mean >= low) & (mean <= high)})


#: The adaptive detector's ratio, its window in frames to either side, and its least change.
ADAPTIVE_RATIO, ADAPTIVE_WINDOW, ADAPTIVE_LEAST = 3.0, 2, 15.0


def _cut_content(value: str, own, threshold: float) -> Column:
    return F.abs(F.col(value) - F.lag(value).over(own)) > threshold


def _cut_threshold(value: str, own, threshold: float) -> Column:
    return (F.col(value) >= threshold) & (F.lag(value).over(own) < threshold)


def _cut_adaptive(value: str, own, threshold: float) -> Column:
    change = F.coalesce(F.abs(F.col(value) - F.lag(value).over(own)), F.lit(0.0))
    before, after = ([F.coalesce(F.abs(F.lag(value, i).over(own) - F.lag(value, i + 1).over(own)), F.lit(0.0)) for i in r] for r in (range(1, ADAPTIVE_WINDOW + 1), range(-ADAPTIVE_WINDOW, 0)))
    around = sum(before + after, F.lit(0.0)) / (2 * ADAPTIVE_WINDOW)
    return (change >= ADAPTIVE_LEAST) & (change >= ADAPTIVE_RATIO * F.greatest(around, F.lit(1e-5)))


#: Detectors by name. content: a frame differs from the one before by more than the threshold. threshold: a frame is as
#: bright as the threshold after a darker one (a fade in). adaptive: the change is large against those around it.
DETECTORS = {"content": _cut_content, "threshold": _cut_threshold, "adaptive": _cut_adaptive}


def scene_segments(frames: DataFrame, clip: str, value: str, time: str, threshold: float, detector: str = "content") -> DataFrame:
    """(clip, scene, start_sec, end_sec, n_frames): a new scene begins where the detector sees a cut; a clip without
    one is a single scene. end_sec is the start of the next scene, of the last scene its last frame. Unknown detectors
    are refused (ValueError)."""
    if detector not in DETECTORS:
        raise ValueError(f"unknown detector: {detector}")
    own = Window.partitionBy(clip).orderBy("frame_idx")
    cuts = frames.withColumn("_cut", F.coalesce(DETECTORS[detector](value, own, threshold).cast("int"), F.lit(0)))
    numbered = cuts.withColumn("scene", F.sum("_cut").over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    per = numbered.groupBy(clip, "scene").agg(F.min(time).alias("start_sec"), F.max(time).alias("_last"), F.count("*").alias("n_frames"))
    following = F.lead("start_sec").over(Window.partitionBy(clip).orderBy("scene"))
    return per.withColumn("end_sec", F.coalesce(following, F.col("_last"))).select(clip, "scene", "start_sec", "end_sec", "n_frames")


def scene_info(segments: DataFrame, clip: str) -> DataFrame:
    """(clip, n_scenes, dominant_scene_start_sec, dominant_scene_end_sec, dominant_scene_duration_sec,
    scene_change_rate): the dominant scene is the first of the longest; rate = (n - 1) / max(total, 1e-6)."""
    length = F.col("end_sec") - F.col("start_sec")
    longest = F.max(F.struct(length.alias("d"), (-F.col("scene")).alias("k"), "start_sec", "end_sec"))
    per = segments.groupBy(clip).agg(F.count("*").cast("int").alias("n_scenes"), longest.alias("x"), F.sum(length).alias("t"))
    return per.select(clip, "n_scenes", F.col("x.start_sec").alias("dominant_scene_start_sec"), F.col("x.end_sec").alias("dominant_scene_end_sec"), F.col("x.d").alias("dominant_scene_duration_sec"), ((F.col("n_scenes") - 1) / F.greatest(F.col("t"), F.lit(1e-6))).alias("scene_change_rate"))


def trim_to_dominant(frames: DataFrame, info: DataFrame, clip: str, time: str, min_duration: float) -> DataFrame:
    """The frames inside the dominant scene of clips whose dominant scene lasts at least min_duration."""
    kept = info.where(F.col("dominant_scene_duration_sec") >= min_duration).select(clip, F.col("dominant_scene_start_sec").alias("_s"), F.col("dominant_scene_end_sec").alias("_e"))
    return frames.join(kept, clip).where(F.col(time).between(F.col("_s"), F.col("_e"))).drop("_s", "_e")


def direction_entropy(counts: DataFrame, group: list[str], n: str) -> DataFrame:
    """Entropy in bits of a histogram (group, bin, n): -sum p log2(p + 1e-9), p = n / (total + 1e-9)."""
    whole = F.sum(n).over(Window.partitionBy(*group))
    p = F.col(n) / (whole + 1e-9)
    return counts.withColumn("_p", p).groupBy(*group).agg((-F.sum(F.col("_p") * F.log2(F.col("_p") + 1e-9))).alias("entropy"))


def normalized_depth(pixels: DataFrame, clip: str, frame: str, value: str) -> DataFrame:
    """(clip, depth_mean, depth_variance) after each frame is scaled to 0..1 (only if it isn't constant)."""
    own = Window.partitionBy(clip, frame)
    low, high = F.min(value).over(own), F.max(value).over(own)
    scaled = pixels.withColumn("_d", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.col(value)))
    return scaled.groupBy(clip).agg(F.avg("_d").alias("depth_mean"), F.var_pop("_d").alias("depth_variance"))


def fallback_caption(label: Column) -> Column:
    return F.concat(F.lit("a person performing "), F.coalesce(F.lower(F.replace(label, F.lit("_"), F.lit(" "))), F.lit("a video clip")))


def caption_missing(caption: Column) -> Column:
    """Null and empty captions are missing."""
    return caption.isNull() | (caption == "")


def fill_captions(clips: DataFrame, made: DataFrame | None = None, key: str = "path") -> DataFrame:
    """clips whose missing captions come from made (key, made_caption), else from the label."""
    base = clips if made is None else clips.join(made, key, "left")
    new = fallback_caption(F.col("label")) if made is None else F.coalesce("made_caption", fallback_caption(F.col("label")))
    return base.withColumn("caption", F.when(caption_missing(F.col("caption")), new).otherwise(F.col("caption"))).drop("made_caption")


def caption_vote(captions: DataFrame, clip: str, order: str, text: str = "text") -> DataFrame:
    """(clip, caption): captions are compared without case, edge blanks and final full stops; a single distinct
    one is taken as first seen, of several the longest (the first on ties). Empty ones do not vote."""
    norm = F.rtrim(F.trim(F.lower(F.col(text))), F.lit("."))
    firsts = captions.where(~caption_missing(F.col(text))).groupBy(clip, norm.alias("_n")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))).alias("f"))
    best = F.max(F.struct(F.length("f.t").alias("len"), (-F.col("f.o")).alias("at"), F.col("f.t").alias("t")))
    return firsts.groupBy(clip).agg(best.alias("x")).select(clip, F.col("x.t").alias("caption"))


def task_report(clips: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """Per class the mean of each column without nulls, rounded half to even to 3 places, and the clips."""
    return clips.groupBy(F.col(label).alias("label")).agg(*(F.bround(F.avg(c), 3).alias(c) for c in columns), F.count("*").alias("n_clips"))


def not_yet_done(clips: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Clips without a finished artefact: an anti join."""
    return clips.join(done.select(key).distinct(), key, "left_anti")


def with_labels(clips: DataFrame, label_map: DataFrame, key: str = "path") -> DataFrame:
    """clips with the label of label_map (key, label), else the name of the folder that the clip lies in."""
    folder = F.try_element_at(F.split(F.col(key), "/"), F.lit(-2))
    return clips.drop("label").join(label_map, key, "left").withColumn("label", F.coalesce("label", folder))
