"""Row generators: augmentation fan-out, frame resampling, synthesis plans, export of captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.order import uniform
from framewright.operators.distribute import join_unique
from framewright.operators.mixture import choices
from framewright.operators.scores import caption_missing

SPEEDS = [0.75, 1.25]
JITTER_PROBABILITY, SPEED_PROBABILITY = 0.8, 0.5
#: What a class without templates of its own is synthesised with.
DEFAULT_TEMPLATES = [
    "a person performing {class_name} in an outdoor setting, daytime",
    "close view of {class_name} activity, varied background",
    "a professional demonstrating {class_name}, studio setting",
]


def augmentation_base(clips: DataFrame, multiplier: float, key: str = "path", seed: int = 42) -> DataFrame:
    """int(n * multiplier) draws with replacement (column draw)."""
    return choices(clips, int(clips.count() * multiplier), key, seed, "augment")


def fan_out(clips: DataFrame, key: str = "path", seed: int = 42, interpolation: bool = True, jitter: float = JITTER_PROBABILITY, speed: float = SPEED_PROBABILITY, speeds: list[float] | None = None) -> DataFrame:
    """clips times their augmentations, with aug_type and aug_path: one interpolation, a jitter with probability
    `jitter`, and with probability `speed` each speed. Draws depend on (seed, key, draw) only.

    An output's name carries the draw, so a clip that was drawn twice does not overwrite itself.
    """
    parts = [F.col(key), F.col("draw")] if "draw" in clips.columns else [F.col(key)]
    draw = F.col("draw").cast("string") if "draw" in clips.columns else F.lit("0")
    u = lambda salt: uniform(seed, salt, *parts)
    stem = F.regexp_replace(F.col(key), r"\.[^./]*$", "")
    kinds = [("interp", F.lit(interpolation)), ("jitter", u("jitter") < jitter)]
    kinds += [(f"speed{s}", u("speed") < speed) for s in (SPEEDS if speeds is None else speeds)]
    made = F.filter(F.array(*(F.when(on, F.struct(F.lit(name).alias("aug_type"), F.concat(stem, F.lit(f"_{name}_"), draw, F.lit(".mp4")).alias("aug_path"))) for name, on in kinds)), lambda x: x.isNotNull())
    return clips.withColumn("_a", F.explode(made)).select("*", "_a.aug_type", "_a.aug_path").drop("_a")


SCORES = ["blur_score", "motion_score", "quality_score"]


def synthetic_rows(fanned: DataFrame, key: str = "path", stale_scores: bool = False) -> DataFrame:
    """Manifest rows of a fan-out: path, is_synthetic and source_path are replaced. The source's scores do not
    describe the new clip; they become null unless stale_scores is set."""
    rows = fanned.withColumns({"source_path": F.col(key), "is_synthetic": F.lit(True)}).withColumn(key, F.col("aug_path")).drop("aug_path", "aug_type", "draw")
    return rows if stale_scores else rows.withColumns({c: F.lit(None).cast("double") for c in SCORES if c in rows.columns})


def interpolate_frames(frames: DataFrame, clip: str, value: str, multiplier: int) -> DataFrame:
    """(clip, out_idx, value): multiplier - 1 blends between consecutive frames, m(n - 1) + 1 frames in all.

    value is a number, or an array of pixels; blends are cut off to whole numbers.
    """
    own = Window.partitionBy(clip).orderBy("frame_idx")
    place = F.row_number().over(own) - 1
    with_next = frames.withColumns({"_i": place, "_next": F.lead(value).over(own)})
    steps = F.when(F.col("_next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(multiplier - 1)))
    t = F.col("_s") / F.lit(float(multiplier))
    blend = lambda a, b: F.floor(a * (1 - t) + b * t)
    array = dict(frames.dtypes)[value].startswith("array")
    mixed = F.zip_with(F.col(value), F.col("_next"), blend) if array else blend(F.col(value), F.col("_next"))
    out = with_next.withColumn("_s", F.explode(steps))
    return out.select(clip, (F.col("_i") * multiplier + F.col("_s")).alias("out_idx"), F.when(F.col("_s") == 0, F.col(value)).otherwise(mixed).alias(value))


def speed_indices(n: Column, factor: float) -> Column:
    """Source frame numbers of a clip of n frames played at `factor`; null where the factor is 1."""
    if abs(factor - 1) < 1e-3:
        return F.lit(None).cast("array<int>")
    out = F.floor(n / F.lit(float(factor)))
    if factor > 1:
        size = F.greatest(F.lit(1), out)
        at = lambda i: F.floor(i * n / size).cast("int")
    else:
        size = out
        at = lambda i: F.least(F.floor(i * F.lit(float(factor))), n - 1).cast("int")
    return F.when(size > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), size - 1), at)).otherwise(F.array().cast("array<int>"))


def speed_variants(clips: DataFrame, clip: str, n: str, factors: list[float]) -> DataFrame:
    """(clip, factor, out_idx, frame_idx) of each variant; factor 1 makes none."""
    sets = F.filter(F.array(*(F.struct(F.lit(float(f)).alias("factor"), speed_indices(F.col(n), f).alias("idx")) for f in factors)), lambda x: x["idx"].isNotNull())
    long = clips.select(clip, F.explode(sets).alias("x"))
    return long.select(clip, "x.factor", F.posexplode("x.idx").alias("out_idx", "frame_idx"))


def apply_speed(frames: DataFrame, clip: str, value: str, factors: list[float]) -> DataFrame:
    """(clip, factor, out_idx, value): frames (clip, frame_idx, value) of every variant."""
    sizes = frames.groupBy(clip).agg(F.count("*").alias("_n"))
    return speed_variants(sizes, clip, "_n", factors).join(frames.select(clip, "frame_idx", value), [clip, "frame_idx"]).select(clip, "factor", "out_idx", value)


def synthesis_plan(classes: DataFrame, per_class: int, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(class, i, prompt, seed): per_class prompts of each class (column class), templates in turn, seed = i."""
    name = F.lower(F.replace(F.col("class"), F.lit("_"), F.lit(" ")))
    default = F.transform(F.array(*map(F.lit, DEFAULT_TEMPLATES)), lambda t: F.replace(t, F.lit("{class_name}"), name))
    own = F.lit(None).cast("array<string>")
    for label, lines in (templates or {}).items():
        own = F.when(F.col("class") == label, F.array(*map(F.lit, lines))).otherwise(own)
    lines = F.coalesce(own, default)
    grown = classes.select("class", lines.alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))).alias("i"))
    return grown.select("class", "i", F.element_at("_t", F.col("i") % F.size("_t") + 1).alias("prompt"), F.col("i").alias("seed"))


def prompts_from_captions(clips: DataFrame, label: str, n: int, order: list[str], prefix: str = "", label_column: str = "label") -> DataFrame:
    """(prompt): the first n captions of a class, with a prefix."""
    return clips.where((F.col(label_column) == label) & ~caption_missing(F.col("caption"))).orderBy(*order).limit(n).select(F.concat(F.lit(prefix), "caption").alias("prompt"))


def file_parts(path: Column) -> dict[str, Column]:
    """name, stem, suffix and the name of the folder."""
    name = F.element_at(F.split(path, "/"), -1)
    return {"name": name, "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "suffix": F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1), "folder": F.try_element_at(F.split(path, "/"), F.lit(-2))}


def export_captions(clips: DataFrame, order: list[str], key: str = "path") -> DataFrame:
    """(key, out_name, caption): the first clip of a file name keeps its stem, later ones get the label in front;
    the caption is the clip's own, else its label, else empty. order is total (clips that tie for the first place all
    keep their stem); only the first of each name is looked for, so a frequent name is no hot task."""
    parts = file_parts(F.col(key))
    named = clips.select(key, "label", "caption", *(c for c in order if c not in (key, "label", "caption")), parts["name"].alias("_name"), parts["stem"].alias("_stem"))
    named = named.withColumn("_at", F.struct(*order))
    firsts = named.groupBy("_name").agg(F.min("_at").alias("_first"))
    named = join_unique(named, firsts, "_name", "inner")
    out = F.when(F.col("_at") == F.col("_first"), F.col("_stem")).otherwise(F.concat(F.coalesce("label", F.lit("")), F.lit("_"), F.col("_stem")))
    return named.select(key, out.alias("out_name"), F.coalesce(F.nullif("caption", F.lit("")), F.col("label"), F.lit("")).alias("caption"))


def ratio_dir(ratio: float) -> str:
    return f"ratio_{ratio:.2f}".replace(".", "p")
