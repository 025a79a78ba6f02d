"""Readers of frames: which frames of a clip are taken, by one of four rules, and stacks of them as tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.kernels.images import _attempt, _frame, normalize_tensor, resize
from framewright.operators.scores import linspace_indices, strided_indices, uniform_indices

RULES = ["uniform", "uniform_or_all", "ends", "stride"]


def indices(rule: str, total: Column, n: int, fps: Column | None = None, target_fps: float | None = None) -> Column:
    """Numbers of the frames that a rule takes of a clip of `total` frames.

    uniform: int(i * total / n), always n of them (short clips repeat frames). uniform_or_all: the same, every frame of
    clips shorter than n. ends: n frames with the first and the last, each once, so short clips give fewer; pad fills
    up. stride: every stride-th frame to come close to target_fps (without one, every frame), and n of these evenly.
    """
    if rule not in RULES:
        raise ValueError(f"unknown sampling rule: {rule}")
    if rule == "ends":
        return F.array_distinct(linspace_indices(total, n))
    if rule == "stride":
        native = F.lit(1.0) if fps is None or target_fps is None else fps
        return strided_indices(total, native, 1.0 if fps is None or target_fps is None else target_fps, n)
    return uniform_indices(total, n, all_if_short=rule == "uniform_or_all")


def sample_frames(frames: DataFrame, rule: str, n: int, clip: str = "path", pad: bool = False, fps: str | None = None, target_fps: float | None = None) -> DataFrame:
    """frames (clip, frame_idx, total, ...) of the sample: with `place`, their place in it from 0.

    pad repeats the last frame until there are n. Frames that a rule names but the clip lacks are left out. The places
    are looked up in each frame's own row, so nothing is shuffled.
    """
    wanted = indices(rule, F.col("total"), n, None if fps is None else F.col(fps), target_fps)
    placed = F.filter(F.transform(wanted, lambda x, i: F.struct(x.alias("at"), i.alias("place"))), lambda x: x["at"] == F.col("frame_idx"))
    if pad:
        last = F.element_at(wanted, -1)
        fill = F.when((F.size(wanted) < n) & (F.col("frame_idx") == last), F.transform(F.sequence(F.size(wanted), F.lit(n - 1)), lambda i: F.struct(last.alias("at"), i.alias("place"))))
        placed = F.concat(placed, F.coalesce(fill, F.array().cast("array<struct<at:int,place:int>>")))
    return frames.withColumn("_p", F.explode(placed)).withColumn("place", F.col("_p.place")).drop("_p")


def tensors(sample: DataFrame, size: int | None = 224, clip: str = "path") -> DataFrame:
    """(clip, place, channels, height, width, values, error): each sampled frame as float32 numbers, channel by channel,
    scaled to 0..1, resized to size x size (None keeps it) and normalised by the usual means and deviations. Pixels are
    blue-green-red, the channels of the result red-green-blue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes, values, errors = [], [], []
            for r in batch.to_pylist():

                def made(r=r) -> np.ndarray:
                    f = _frame(r["pixels"], r["h"], r["w"], r["c"]).astype(np.float64)
                    f = f[..., None].repeat(3, axis=2) if f.ndim == 2 else f[..., 2::-1]
                    if size is not None:
                        f = np.stack([resize(f[..., k], size, size) for k in range(3)], axis=-1)
                    return normalize_tensor(f).transpose(2, 0, 1)

                out, error = _attempt(made)
                shapes.append((None,) * 3 if out is None else out.shape)
                values.append(None if out is None else out.ravel())
                errors.append(error)
            columns = [pa.array([s[k] for s in shapes], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(clip), batch.column("place"), *columns, pa.array(values, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[clip, "place", "channels", "height", "width", "values", "error"])

    rows = sample.select(F.col(clip).cast("string").alias(clip), F.col("place").cast("int").alias("place"), "h", "w", "c", "pixels")
    return rows.mapInArrow(run, f"`{clip}` string, place int, channels int, height int, width int, `values` array<float>, error string")


def profile_peak(weights: Column) -> Column:
    """The greatest share in a temporal profile of attention weights; null without weights."""
    return F.array_max(shares(weights))


def profile_entropy(weights: Column) -> Column:
    """Entropy of a temporal profile in bits: -sum p log2(p + 1e-9)."""
    return -F.aggregate(F.transform(shares(weights), lambda p: p * F.log2(p + 1e-9)), F.lit(0.0), lambda a, x: a + x)


def shares(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda x: x / total)


def temporal_profile(attention: Column, places: int) -> Column:
    """Attention weights (places x patches, one after another) summed up per place in time."""
    per = F.floor(F.size(attention) / places).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(places - 1)), lambda i: F.aggregate(F.slice(attention, i * per + 1, per), F.lit(0.0), lambda a, x: a + x.cast("double")))
