"""Pixel kernels in numpy, one frame or frame pair at a time, and the Arrow operator that runs them.

A frame is an array of height x width (x 3, blue-green-red) bytes; in a DataFrame it is a row (clip, frame_idx,
h, w, c, pixels BINARY). Kernels are looked up by name; unknown names are refused. Models (optical flow nets and the
like) are not part of the engine: register() takes any function of the same form, or one that loads it. Encoders of
frames and texts are in kernels/encoders.py.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of blue, green and red.
GRAY = np.array([0.114, 0.587, 0.299])
IMAGENET_MEAN, IMAGENET_STD = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])


def gray(frame: np.ndarray) -> np.ndarray:
    """Luminance as float32; a frame of two dimensions is gray already."""
    return frame.astype(np.float32) if frame.ndim == 2 else (frame[..., :3] @ GRAY).astype(np.float32)


def laplacian_variance(frame: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian; the image wraps around at its borders."""
    g = gray(frame).astype(np.float64)
    sides = sum(np.roll(g, s, axis) for axis in (0, 1) for s in (1, -1))
    return float((sides - 4 * g).var())


@functools.lru_cache(64)
def _outside(h: int, w: int, cutoff: float) -> np.ndarray:
    """Frequencies outside the circle, in the order of the transform."""
    y, x = np.ogrid[:h, :w]
    return np.fft.ifftshift((y - h // 2) ** 2 + (x - w // 2) ** 2 > int(min(h, w) * cutoff) ** 2)


def fft_energy(frame: np.ndarray, cutoff: float = 0.3) -> float:
    """Mean magnitude of frequencies outside a circle of radius int(min(h, w) * cutoff) around zero."""
    g = gray(frame).astype(np.float64)
    outside = _outside(*g.shape, cutoff)
    return float(np.abs(np.fft.fft2(g))[outside].mean()) if outside.any() else 0.0


def noise_proxy(frame: np.ndarray) -> float:
    """max(0, 100 - deviation of the luminance): lower is better. Known as brisque as well."""
    return float(max(0.0, 100.0 - gray(frame).astype(np.float64).std()))


@functools.lru_cache(64)
def _gauss(size: int, sigma: float) -> np.ndarray:
    at = np.arange(size) - size // 2
    k = np.exp(-(at**2) / (2 * sigma**2))
    return k / k.sum()


def _smooth(g: np.ndarray, size: int = 7, sigma: float = 7 / 6) -> np.ndarray:
    """Gaussian blur by two passes, borders mirrored without repeating the edge."""
    k = _gauss(size, sigma)
    for axis in (0, 1):
        pad = [(size // 2, size // 2) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(g, pad, mode="reflect" if g.shape[axis] > size // 2 else "edge")
        g = sum(w * np.take(padded, np.arange(i, i + g.shape[axis]), axis) for i, w in enumerate(k))
    return g


def niqe_proxy(frame: np.ndarray) -> float:
    """max(0, 100 - 2 * mean local deviation) with a Gaussian window of 7."""
    g = gray(frame).astype(np.float64)
    mean = _smooth(g)
    return float(max(0.0, 100.0 - 2 * np.sqrt(np.maximum(_smooth(g * g) - mean * mean, 0)).mean()))


def combined_quality(frame: np.ndarray) -> float:
    return (noise_proxy(frame) + niqe_proxy(frame)) / 2


def frame_difference(a: np.ndarray, b: np.ndarray) -> float:
    """Motion of a pair: mean absolute difference of luminance, divided by 10."""
    return float(np.abs(gray(b).astype(np.float64) - gray(a)).mean() / 10)


def flow_statistics(flow: np.ndarray, bins: int = 8) -> dict[str, float]:
    """Of a field (h, w, 2): mean and 95th percentile of the magnitude, mean divergence, direction entropy."""
    u, v = flow[..., 0].astype(np.float64), flow[..., 1].astype(np.float64)
    size = np.hypot(u, v)
    hist = np.histogram(np.arctan2(v, u), bins=bins, range=(-np.pi, np.pi))[0].astype(np.float64)
    p = hist / (hist.sum() + 1e-9)
    divergence = (np.gradient(u, axis=1) + np.gradient(v, axis=0)).mean() if min(u.shape) > 1 else 0.0
    return {"mean": float(size.mean()), "p95": float(np.percentile(size, 95)), "divergence": float(divergence), "entropy": float(-(p * np.log2(p + 1e-9)).sum())}


def depth_statistics(frames: np.ndarray) -> tuple[float, float]:
    """(mean, variance) after each frame of a depth stack is scaled to 0..1, unless it is constant."""
    d = frames.astype(np.float64)
    low, high = d.min(axis=(1, 2), keepdims=True), d.max(axis=(1, 2), keepdims=True)
    scaled = np.where(high > low, (d - low) / np.where(high > low, high - low, 1), d)
    return float(scaled.mean()), float(scaled.var())


def resize(g: np.ndarray, h: int, w: int) -> np.ndarray:
    """The mean over each new pixel's area."""
    return _area(g.shape[0], h) @ g @ _area(g.shape[1], w).T


@functools.lru_cache(256)
def _area(n: int, m: int) -> np.ndarray:
    """Share of each of n old places in each of m new ones."""
    edges = np.linspace(0, n, m + 1)
    cover = np.clip(np.minimum(edges[1:, None], np.arange(n) + 1) - np.maximum(edges[:-1, None], np.arange(n)), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def _bits(mask: np.ndarray) -> int:
    """Signed 64-bit number of a 64-bit mask, first bit highest."""
    return int.from_bytes(np.packbits(mask.ravel()).tobytes(), "big", signed=True)


def ahash(frame: np.ndarray) -> int:
    s = resize(gray(frame).astype(np.float64), 8, 8)
    return _bits(s > s.mean())


def dhash(frame: np.ndarray) -> int:
    s = resize(gray(frame).astype(np.float64), 8, 9)
    return _bits(s[:, 1:] > s[:, :-1])


@functools.lru_cache(8)
def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def phash(frame: np.ndarray) -> int:
    """Sign against the median of the 8 x 8 lowest cosine coefficients of a 32 x 32 image."""
    c = _cosines(32)
    low = (c @ resize(gray(frame).astype(np.float64), 32, 32) @ c.T)[:8, :8]
    return _bits(low > np.median(low))


def whash(frame: np.ndarray) -> int:
    """Against the median of the Haar approximation at 8 x 8, the overall mean removed."""
    s = resize(gray(frame).astype(np.float64), 64, 64)
    while s.shape[0] > 8:
        s = (s[::2, ::2] + s[1::2, ::2] + s[::2, 1::2] + s[1::2, 1::2]) / 2
    s = s - s.mean()
    return _bits(s > np.median(s))


def normalize_tensor(frame: np.ndarray, mean: np.ndarray = IMAGENET_MEAN, std: np.ndarray = IMAGENET_STD) -> np.ndarray:
    return ((frame / 255.0 - mean) / std).astype(np.float32)


def adjust_brightness(frame: np.ndarray, factor: float) -> np.ndarray:
    return np.clip(frame.astype(np.float64) * factor, 0, 255).astype(np.uint8)


def adjust_contrast(frame: np.ndarray, factor: float) -> np.ndarray:
    f = frame.astype(np.float64)
    return np.clip((f - f.mean()) * factor + f.mean(), 0, 255).astype(np.uint8)


def adjust_color(frame: np.ndarray, saturation: float = 1.0, hue: float = 0.0) -> np.ndarray:
    """Saturation by a factor; hue turned by degrees (only by more than one degree). Blue-green-red bytes."""
    f = frame.astype(np.float64) / 255
    high, low = f.max(axis=-1), f.min(axis=-1)
    span = high - low
    safe = np.where(span > 0, span, 1)
    b, g, r = f[..., 0], f[..., 1], f[..., 2]
    angle = np.where(high == r, ((g - b) / safe) % 6, np.where(high == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    angle = (np.where(span > 0, angle, 0) + (hue if abs(hue) > 1 else 0)) % 360
    sat = np.clip(np.where(high > 0, span / np.where(high > 0, high, 1), 0) * saturation, 0, 1)

    def channel(n: int) -> np.ndarray:
        k = (n + angle / 60) % 6
        return high - high * sat * np.clip(np.minimum(k, 4 - k), 0, 1)

    return np.clip(np.round(np.stack([channel(1), channel(3), channel(5)], axis=-1) * 255), 0, 255).astype(np.uint8)


def jitter_parameters(seed: int, key: str, brightness: float = 0.2, contrast: float = 0.2, saturation: float = 0.2, hue: float = 10.0) -> dict[str, float]:
    """One draw a clip, from (seed, key) alone."""
    rng = np.random.default_rng([seed, *key.encode()])
    span = lambda x: float(rng.uniform(1 - x, 1 + x))
    return {"brightness": span(brightness), "contrast": span(contrast), "saturation": span(saturation), "hue": float(rng.uniform(-hue, hue))}


def jitter(frame: np.ndarray, p: dict[str, float]) -> np.ndarray:
    out = adjust_contrast(adjust_brightness(frame, p["brightness"]), p["contrast"])
    return adjust_color(out, p["saturation"], p["hue"]) if out.ndim == 3 else out


Kernel = Callable[[np.ndarray], float]
KERNELS: dict[str, Callable] = {
    "laplacian": laplacian_variance, "fft": fft_energy, "noise_proxy": noise_proxy, "brisque": noise_proxy, "niqe": niqe_proxy,
    "combined": combined_quality, "phash": phash, "dhash": dhash, "ahash": ahash, "whash": whash,
}
PAIR_KERNELS: dict[str, Callable] = {"frame_diff": frame_difference}
#: Kernels that look at nothing but luminance, which is then computed once for all of them.
OF_LUMINANCE = frozenset(KERNELS.values())


class Loaded:
    """A kernel that `load` returns; it is called once in each worker process, at the first frame."""

    made: dict[str, Callable] = {}

    def __init__(self, name: str, load: Callable[[], Callable]):
        self.name, self.load = name, load

    def __call__(self, *frames: np.ndarray) -> float:
        if self.name not in Loaded.made:
            Loaded.made[self.name] = self.load()
        return Loaded.made[self.name](*frames)


def register(name: str, kernel: Callable | None = None, pairs: bool = False, load: Callable[[], Callable] | None = None) -> None:
    """Add a kernel, or one that load() returns on the workers (a model: flow nets for pairs, scorers for frames)."""
    if (kernel is None) == (load is None):
        raise ValueError("either a kernel or a function that loads it")
    (PAIR_KERNELS if pairs else KERNELS)[name] = kernel or Loaded(name, load)


def _kernel(table: dict[str, Callable], name: str) -> Callable:
    if name not in table:
        raise ValueError(f"unknown kernel: {name}")
    return table[name]


def _frame(raw: bytes, h: int, w: int, c: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape((h, w) if c == 1 else (h, w, c))


def _attempt(work: Callable):
    """(result, None), or (None, the reason) where it fails, so that one broken clip does not end the job."""
    try:
        return work(), None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"


def score_frames(frames: DataFrame, kernels: dict[str, str], clip: str = "path") -> DataFrame:
    """(clip, frame_idx, one column per kernel, error): frames in, numbers out, pixels decoded once for all.

    kernels: column -> kernel name; hashes are bigint, others double. A frame that a kernel fails on has nulls and
    the reason in `error`, so one broken clip does not end the job.
    """
    chosen = {column: _kernel(KERNELS, name) for column, name in kernels.items()}
    whole = {column for column, name in kernels.items() if name.endswith("hash")}
    schema = f"`{clip}` string, frame_idx int, " + "".join(f"`{c}` {'bigint' if c in whole else 'double'}, " for c in kernels) + "error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in kernels}
            errors = []
            for r in batch.to_pylist():

                def values_of(r=r) -> list[float]:
                    frame = _frame(r["pixels"], r["h"], r["w"], r["c"])
                    plain = gray(frame)  # once for all kernels that look at luminance only
                    return [k(plain if k in OF_LUMINANCE else frame) for k in chosen.values()]

                values, error = _attempt(values_of)
                for c, v in zip(kernels, values or [None] * len(chosen), strict=True):
                    out[c].append(v)
                errors.append(error)
            columns = [batch.column(clip), batch.column("frame_idx"), *(pa.array(v, pa.int64() if c in whole else pa.float64()) for c, v in out.items()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[clip, "frame_idx", *kernels, "error"])

    rows = frames.select(F.col(clip).cast("string").alias(clip), F.col("frame_idx").cast("int").alias("frame_idx"), "h", "w", "c", "pixels")
    return rows.mapInArrow(run, schema)


def score_pairs(frames: DataFrame, kernel: str = "frame_diff", clip: str = "path", n_pairs: int = 6) -> DataFrame:
    """(clip, start, magnitude, error) of the sampled pairs of consecutive frames; frames need `total`. A pair that
    the kernel fails on has no magnitude and the reason in `error`."""
    chosen = _kernel(PAIR_KERNELS, kernel)
    following = F.lead("pixels").over(Window.partitionBy(clip).orderBy("frame_idx"))
    step = F.greatest(F.lit(1), F.floor((F.col("total") - 1) / n_pairs)).cast("int")
    pairs = frames.withColumns({"next": following, "_step": step}).where((F.col("frame_idx") % F.col("_step") == 0) & (F.col("frame_idx") / F.col("_step") < n_pairs) & F.col("next").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, errors = zip(*(_attempt(lambda r=r: chosen(*(_frame(r[k], r["h"], r["w"], r["c"]) for k in ("pixels", "next")))) for r in batch.to_pylist()), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(clip), batch.column("start"), pa.array(sizes, pa.float64()), pa.array(errors, pa.string())], names=[clip, "start", "magnitude", "error"])

    return pairs.select(F.col(clip).cast("string").alias(clip), F.col("frame_idx").cast("int").alias("start"), "h", "w", "c", "pixels", "next").mapInArrow(run, f"`{clip}` string, start int, magnitude double, error string")


def jitter_frames(frames: DataFrame, clip: str = "path", seed: int = 42) -> DataFrame:
    """frames with jittered pixels; all frames of a clip share one draw of parameters. A frame that can't be read has
    null pixels and the reason in `error`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, errors = zip(*(_attempt(lambda r=r: jitter(_frame(r["pixels"], r["h"], r["w"], r["c"]), jitter_parameters(seed, r[clip])).tobytes()) for r in batch.to_pylist()), strict=True) if len(batch) else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (clip, "frame_idx", "h", "w", "c")), pa.array(pixels, pa.binary()), pa.array(errors, pa.string())], names=[clip, "frame_idx", "h", "w", "c", "pixels", "error"])

    rows = frames.select(F.col(clip).cast("string").alias(clip), F.col("frame_idx").cast("int").alias("frame_idx"), *(F.col(x).cast("int").alias(x) for x in ("h", "w", "c")), "pixels")
    return rows.mapInArrow(run, f"`{clip}` string, frame_idx int, h int, w int, c int, pixels binary, error string")


def synthetic_clips(spark, clips: int, copies: int = 0, frames: int = 8, height: int = 60, width: int = 80, seed: int = 42) -> DataFrame:
    """Frames of random clips, and of `copies` noisy duplicates of them (path dup_*, source_path), as test corpus:
    half of the copies with a deviation of 2 grey levels, half with 8. Each clip's content follows from its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in batch.column("id").to_pylist():
                own = i if i < clips else i - clips
                rng = np.random.default_rng([seed, own])
                grid = rng.integers(0, 256, (6, 8, 3)).astype(np.float64)
                still = np.kron(grid, np.ones((-(-height // 6), -(-width // 8), 1)))[:height, :width]
                noise = np.random.default_rng([seed, i, 1])
                for k in range(frames):
                    f = np.roll(still, 2 * k, axis=1)
                    if i >= clips:
                        f = f + noise.normal(0, 2 if (i - clips) % 2 == 0 else 8, f.shape)
                    name = f"clip_{own:06d}.mp4" if i < clips else f"dup_{own:06d}.mp4"
                    rows.append((name, None if i < clips else f"clip_{own:06d}.mp4", k, frames, height, width, 3, np.clip(f, 0, 255).astype(np.uint8).tobytes()))
            names = ["path", "source_path", "frame_idx", "total", "h", "w", "c", "pixels"]
            kinds = [pa.string(), pa.string(), *[pa.int32()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(8)], names=names)

    return spark.range(clips + min(copies, clips)).mapInArrow(run, "path string, source_path string, frame_idx int, total int, h int, w int, c int, pixels binary")
