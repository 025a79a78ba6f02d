"""The curation plan: scores, gates, order-preserving dedup, manifest."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.bias import blur_gate, motion_gate
from framewright.operators.dedup import dedup_clips
from framewright.operators.mixture import label_encode
from framewright.session import cut


@dataclass(frozen=True)
class Gate:
    enabled: bool = True
    low: float = 0.0
    high: float = 1e9


@dataclass(frozen=True)
class CurationConfig:
    """Thresholds of the plan; a stage that is not enabled passes every clip."""

    blur: Gate = field(default_factory=lambda: Gate(low=40.0))
    quality: Gate = field(default_factory=lambda: Gate(high=50.0))
    motion: Gate = field(default_factory=lambda: Gate(low=2.0, high=80.0))
    min_scene_duration: float = 0.0
    dedup: bool = True
    dedup_method: str = "phash"
    dedup_threshold: float | None = None


def gates(config: CurationConfig) -> dict[str, F.Column]:
    """One boolean column per stage: scene, quality, motion."""
    blur = blur_gate(config.blur.low) if config.blur.enabled else F.lit(True)
    quality = (F.coalesce("quality_score", F.lit(0.0)) <= config.quality.high) if config.quality.enabled else F.lit(True)
    motion = motion_gate(config.motion.low, config.motion.high) if config.motion.enabled else F.lit(True)
    scene = F.coalesce("duration_sec", F.lit(float("inf"))) >= config.min_scene_duration
    return {"passes_scene": scene, "passes_quality": blur & quality, "passes_motion": motion}


def curate(clips: DataFrame, config: CurationConfig, score_only: bool = False) -> DataFrame:
    """Clips that pass every gate and are no duplicate of one before them, with label_idx.

    clips: manifest columns plus ord (order of arrival) and hs or vec for dedup. Gates are one filter for
    Catalyst; dedup sees survivors only, in order. score_only keeps all clips and adds the gates' verdicts.
    """
    flags = gates(config)
    flagged = clips.withColumns(flags)
    if score_only:
        return flagged
    kept = flagged.where(" and ".join(flags)).drop(*flags)
    if config.dedup:
        kept = cut(kept)
        verdicts = dedup_clips(kept, config.dedup_method, config.dedup_threshold)
        kept = cut(verdicts.where(~F.col("is_duplicate")).drop("is_duplicate", "duplicate_of", "score", "hash_str"))
    return label_encode(kept)


def stage_counts(clips: DataFrame, config: CurationConfig) -> DataFrame:
    """One row: clips that come in and that are left after each gate, in order. One scan."""
    f = gates(config)
    scene, quality, motion = f["passes_scene"], f["passes_quality"], f["passes_motion"]
    return clips.agg(F.count("*").alias("n_in"), F.count_if(scene).alias("after_scene"), F.count_if(scene & quality).alias("after_quality"), F.count_if(scene & quality & motion).alias("after_motion"))
