"""Evaluation end to end: from frames and captions to Frechet distance, clip score, recall and compactness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.kernels.encoders import encode_clips, encode_texts, encoder
from framewright.operators.distribute import global_rank
from framewright.operators.metrics import evaluate, frechet_distance, unit
from framewright.operators.scores import caption_missing
from framewright.session import cut


def first_clips(frames: DataFrame, max_clips: int | None, clip: str = "path") -> DataFrame:
    """The frames of the first max_clips clips by path; all without a limit."""
    if max_clips is None:
        return frames
    return frames.join(frames.select(clip).distinct().orderBy(clip).limit(max_clips), clip, "left_semi")


def evaluate_fvd(real: DataFrame, generated: DataFrame, model: str, max_clips: int | None = None) -> float:
    """Frechet distance of the clips of two sets of frames by an encoder's vectors; NaN if either has fewer than two
    clips. Only limited sets are encoded."""
    vectors = [encode_clips(first_clips(f, max_clips), model) for f in (real, generated)]
    return frechet_distance(*vectors, "vec")


def evaluate_clip(frames: DataFrame, clips: DataFrame, video_model: str, text_model: str, max_clips: int | None = None, every: int = 1) -> DataFrame:
    """metrics.evaluate of clips (path, label, caption) and their frames. Clips without a caption count only if none
    has one. Both encoders have one length (ValueError otherwise). every: see metrics.evaluate."""
    size = encoder(video_model).size
    if encoder(text_model).size != size:
        raise ValueError("the encoders of frames and texts differ in length")
    ranked = global_rank(clips.select("path", "label", "caption"), [F.col("path"), F.col("caption")], "ord")
    if max_clips is not None:
        ranked = ranked.where(F.col("ord") < max_clips)
    ranked = cut(ranked)
    texts = encode_texts(ranked.where(~caption_missing(F.col("caption"))), text_model, "caption", "ord").select("ord", unit(F.col("vec")).alias("text"))
    wanted = frames.join(ranked.select("path").distinct(), "path", "left_semi")
    videos = encode_clips(wanted, video_model, renormalize=True).withColumnRenamed("vec", "video")
    return evaluate(ranked.join(videos, "path", "left").join(texts, "ord", "left"), "ord", size=size, every=every)
