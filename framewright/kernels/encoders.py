"""Encoders: frames or texts in, vectors out, by models that each worker process loads once.

No model is part of the engine. register() takes a name, the length of the vectors and a function that loads the
model: load() returns a function from a list of frames (arrays) or texts to an array with one row each. Two small
encoders without weights to load stand in where none is installed: `channel_means` (means of the colour channels
through a fixed projection) and `letter_counts` (hashed letter triples).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.kernels.images import _attempt, _frame

Encode = Callable[[list], np.ndarray]
#: Fixed value: texts that an encoder gets at a time.
TEXT_BATCH = 32


@dataclass(frozen=True)
class Encoder:
    name: str
    size: int
    load: Callable[[], Encode]


ENCODERS: dict[str, Encoder] = {}
_loaded: dict[str, Encode] = {}


def register(name: str, size: int, load: Callable[[], Encode]) -> None:
    ENCODERS[name] = Encoder(name, size, load)


def encoder(name: str) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder: {name}")
    return ENCODERS[name]


def model_of(chosen: Encoder) -> Encode:
    """The model of an encoder; one per worker process."""
    if chosen.name not in _loaded:
        _loaded[chosen.name] = chosen.load()
    return _loaded[chosen.name]


def _channel_means() -> Encode:
    projection = np.random.default_rng(0).standard_normal((3, 64)) / np.sqrt(3)

    def encode(frames: list[np.ndarray]) -> np.ndarray:
        means = [(f if f.ndim == 3 else f[..., None].repeat(3, axis=2)).reshape(-1, 3).mean(axis=0) for f in frames]
        return np.array(means) / 255 @ projection

    return encode


def _letter_counts() -> Encode:
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 64))
        for row, text in zip(out, texts, strict=True):
            plain = f" {text.lower()} "
            for i in range(len(plain) - 2):
                row[hashlib.blake2b(plain[i : i + 3].encode("utf-8", "surrogatepass"), digest_size=1).digest()[0] % 64] += 1
        return out

    return encode


register("channel_means", 64, _channel_means)
register("letter_counts", 64, _letter_counts)


def _checked(made: np.ndarray, rows: int, size: int) -> np.ndarray:
    if made.shape != (rows, size):
        raise ValueError(f"the encoder returned {made.shape} in place of {(rows, size)}")
    return made


def _encoded(run: Encode, items: list, size: int) -> tuple[list, list]:
    """(vectors, errors) of items; if a batch fails its items are tried one by one, so that only the broken ones fail."""
    made, error = _attempt(lambda: _checked(np.asarray(run(items), np.float64), len(items), size))
    if error is None:
        return made.tolist(), [None] * len(items)
    if len(items) == 1:
        return [None], [error]
    each = [_encoded(run, [x], size) for x in items]
    return [e[0][0] for e in each], [e[1][0] for e in each]


def encode_frames(frames: DataFrame, model: str, clip: str = "path") -> DataFrame:
    """(clip, frame_idx, vec, error) of each frame (h, w, c, pixels); vec is null where the frame or the model fails."""
    chosen = encoder(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [_attempt(lambda r=r: _frame(r["pixels"], r["h"], r["w"], r["c"])) for r in batch.to_pylist()]
            good = [i for i, (f, e) in enumerate(read) if e is None]
            vectors, errors = [None] * len(read), [e for _, e in read]
            if good:
                made, failed = _encoded(model_of(chosen), [read[i][0] for i in good], chosen.size)
                for i, v, e in zip(good, made, failed, strict=True):
                    vectors[i], errors[i] = v, e
            yield pa.RecordBatch.from_arrays([batch.column(clip), batch.column("frame_idx"), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[clip, "frame_idx", "vec", "error"])

    rows = frames.select(F.col(clip).cast("string").alias(clip), F.col("frame_idx").cast("int").alias("frame_idx"), "h", "w", "c", "pixels")
    return rows.mapInArrow(run, f"`{clip}` string, frame_idx int, vec array<double>, error string")


def encode_texts(rows: DataFrame, model: str, text: str, key: str = "path", words: int = 77) -> DataFrame:
    """(key, vec, error) of each text; the model gets its first `words` words, as its window allows. Null texts have
    null vectors."""
    chosen = encoder(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            vectors, errors = [None] * len(texts), [None] * len(texts)
            asked = [i for i, t in enumerate(texts) if t is not None]
            for at in range(0, len(asked), TEXT_BATCH):
                part = asked[at : at + TEXT_BATCH]
                made, failed = _encoded(model_of(chosen), [" ".join(texts[i].split()[:words]) for i in part], chosen.size)
                for i, v, e in zip(part, made, failed, strict=True):
                    vectors[i], errors[i] = v, e
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=[key, "vec", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, vec array<double>, error string")


def encode_clips(frames: DataFrame, model: str, clip: str = "path", renormalize: bool = False) -> DataFrame:
    """(clip, vec): mean of the unit vectors of a clip's frames, of unit length again with renormalize; zeros for
    clips of which no frame could be encoded."""
    from framewright.operators.metrics import mean_of_unit_frames

    size = encoder(model).size
    made = encode_frames(frames, model, clip)
    means = mean_of_unit_frames(made.where("vec is not null"), clip, "vec", size, renormalize)
    zeros = F.array_repeat(F.lit(0.0), size)
    return frames.select(F.col(clip).cast("string").alias(clip)).distinct().join(means, clip, "left").select(clip, F.coalesce("vec", zeros).alias("vec"))
