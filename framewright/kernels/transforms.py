"""Transforms of whole clips and rewriting of texts by tools that are plugged in: interpolation, speed, paraphrases.

A clip transform takes the frames of one clip (arrays, in order) and a number and returns frames; it runs for a clip at
a time, in Arrow groups. External tools (interpolation nets, codecs) are not part of the engine: register() takes a
name and a function that loads the tool once per worker process. Where a tool fails on a clip, the built-in transform
of the same kind can take its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.kernels.images import _attempt, _frame

Transform = Callable[[list[np.ndarray], float], list[np.ndarray]]
Rewrite = Callable[[list[str], int], list[list[str]]]


def linear(frames: list[np.ndarray], multiplier: float) -> list[np.ndarray]:
    """multiplier - 1 blends between neighbouring frames, cut off to whole numbers: m * (n - 1) + 1 frames."""
    m = int(multiplier)
    blends = lambda a, b: [(a.astype(np.float64) * (1 - k / m) + b.astype(np.float64) * (k / m)).astype(np.uint8) for k in range(1, m)]
    return [f for a, b in zip(frames, frames[1:], strict=False) for f in (a, *blends(a, b))] + frames[-1:]


def resampled(frames: list[np.ndarray], factor: float) -> list[np.ndarray]:
    """The clip played at `factor` by leaving out or repeating frames; a factor within 0.001 of 1 changes nothing."""
    n = len(frames)
    if abs(factor - 1) < 1e-3 or not n:
        return frames
    size = max(1, int(n / factor)) if factor > 1 else int(n / factor)
    return [frames[int(i * n / size) if factor > 1 else min(int(i * factor), n - 1)] for i in range(size)]


#: kind -> name -> load(). The first name of a kind is the built-in that others can fall back to.
TRANSFORMS: dict[str, dict[str, Callable[[], Transform]]] = {"interpolation": {"linear": lambda: linear}, "speed": {"index": lambda: resampled}}
BUILT_IN = {kind: next(iter(names)) for kind, names in TRANSFORMS.items()}
REWRITERS: dict[str, Callable[[], Rewrite]] = {}
_loaded: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, load: Callable[[], Transform]) -> None:
    """Add a clip transform of a kind (interpolation, speed)."""
    if kind not in TRANSFORMS:
        raise ValueError(f"unknown kind of transform: {kind}")
    TRANSFORMS[kind][name] = load


def register_rewriter(name: str, load: Callable[[], Rewrite]) -> None:
    """Add a rewriter: from texts and a number to that many versions of each text."""
    REWRITERS[name] = load


def _once(kind: str, name: str, load: Callable[[], Callable]) -> Callable:
    if (kind, name) not in _loaded:
        _loaded[kind, name] = load()
    return _loaded[kind, name]


def transform_clips(frames: DataFrame, kind: str, name: str, number: float, fall_back: bool = True, clip: str = "path") -> DataFrame:
    """(clip, out_idx, h, w, c, pixels, method, error): the frames of each transformed clip. method is the transform
    that made them: `name`, or the built-in of its kind if the tool failed and fall_back is set; error says why. A clip
    that nothing could transform is one row without pixels."""
    if kind not in TRANSFORMS or name not in TRANSFORMS[kind]:
        raise ValueError(f"unknown transform: {kind} {name}")
    spare = BUILT_IN[kind]
    tools = {name: TRANSFORMS[kind][name]} | ({spare: TRANSFORMS[kind][spare]} if fall_back else {})

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["frame_idx"])
        out, method, error = None, None, None
        for tool, load in tools.items():
            made, failed = _attempt(lambda load=load, tool=tool: _once(kind, tool, load)([_frame(r["pixels"], r["h"], r["w"], r["c"]) for r in rows], number))
            error = error or failed
            if failed is None:
                out, method = made, tool
                break
        shapes = [(f.shape[0], f.shape[1], 1 if f.ndim == 2 else f.shape[2]) for f in out] if out is not None else [(None,) * 3]
        pixels = [np.ascontiguousarray(f).tobytes() for f in out] if out is not None else [None]
        n = len(pixels)
        columns = [pa.array([rows[0][clip]] * n, pa.string()), pa.array(list(range(n)) if out is not None else [None], pa.int32()), *(pa.array([s[k] for s in shapes], pa.int32()) for k in range(3)), pa.array(pixels, pa.binary()), pa.array([method] * n, pa.string()), pa.array([error] * n, pa.string())]
        return pa.Table.from_arrays(columns, names=[clip, "out_idx", "h", "w", "c", "pixels", "method", "error"])

    rows = frames.select(F.col(clip).cast("string").alias(clip), F.col("frame_idx").cast("int").alias("frame_idx"), "h", "w", "c", "pixels").where(F.col(clip).isNotNull())
    return rows.groupBy(clip).applyInArrow(run, f"`{clip}` string, out_idx int, h int, w int, c int, pixels binary, method string, error string")


def rewrite_texts(rows: DataFrame, name: str, text: str, versions: int, key: str = "path", batch: int = 32) -> DataFrame:
    """(key, version, text, error): versions of each text that is neither null nor empty, such as paraphrases of a
    caption. A batch that fails is tried text by text; a text that fails is one row without a version."""
    if name not in REWRITERS:
        raise ValueError(f"unknown rewriter: {name}")
    load = REWRITERS[name]

    def made_of(texts: list[str]) -> list[tuple[list[str] | None, str | None]]:
        made, error = _attempt(lambda: _once("rewriter", name, load)(texts, versions))
        if error is None and len(made) == len(texts):
            return [(list(v)[:versions], None) for v in made]
        return [(None, error or "a text has no versions")] if len(texts) == 1 else [x for t in texts for x in made_of([t])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in batches:
            texts = chunk.column(text).to_pylist()
            at, version, out, errors = [], [], [], []
            for lo in range(0, len(texts), batch):
                for i, (made, error) in enumerate(made_of(texts[lo : lo + batch]), lo):
                    for k, v in enumerate(made if made is not None else [None]):
                        at.append(i)
                        version.append(k if made is not None else None)
                        out.append(v)
                        errors.append(error)
            yield pa.RecordBatch.from_arrays([chunk.column(key).take(pa.array(at, pa.int64())), pa.array(version, pa.int32()), pa.array(out, pa.string()), pa.array(errors, pa.string())], names=[key, "version", "text", "error"])

    kind = rows.schema[key].dataType.simpleString()
    asked = rows.select(key, F.col(text)).where(F.col(text).isNotNull() & (F.col(text) != ""))
    return asked.mapInArrow(run, f"`{key}` {kind}, version int, text string, error string")
