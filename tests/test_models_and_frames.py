"""Frame readers, encoders, the vector index, detectors, evaluation, comparison of methods, training batches, sinks."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.kernels import encoders, images
from framewright.operators import dedup, metrics, mixture, scores
from framewright.operators import frames as reader
from framewright.operators.vectors import VectorIndex
from framewright.sources import readers, sinks


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clip_frames(spark, **sizes):
    return spark.createDataFrame([(c, i, n) for c, n in sizes.items() for i in range(n)], "path string, frame_idx int, total int")


@pytest.mark.parametrize("n", [1, 3, 8])
def test_sampling_rules(spark, n):
    df = clip_frames(spark, a=20, b=3, c=1)
    sizes = {"a": 20, "b": 3, "c": 1}
    taken = lambda out: {c: [r["frame_idx"] for r in sorted((r for r in out if r["path"] == c), key=lambda r: r["place"])] for c in sizes}
    assert taken(reader.sample_frames(df, "uniform", n).collect()) == {c: [int(i * t / n) for i in range(n)] for c, t in sizes.items()}
    assert taken(reader.sample_frames(df, "uniform_or_all", n).collect()) == {c: [int(i * t / n) for i in range(n)] if t >= n else list(range(t)) for c, t in sizes.items()}
    ends = {c: sorted({int(x) for x in np.linspace(0, t - 1, n)}) for c, t in sizes.items()}
    assert taken(reader.sample_frames(df, "ends", n).collect()) == ends
    padded = reader.sample_frames(df, "ends", n, pad=True).collect()
    assert taken(padded) == {c: (e + [e[-1]] * n)[:n] for c, e in ends.items()}
    fps = df.withColumn("fps", F.lit(30.0))
    every = {c: list(range(0, t, 4)) for c, t in sizes.items()}
    assert taken(reader.sample_frames(fps, "stride", n, fps="fps", target_fps=8.0).collect()) == {c: e if len(e) <= n else [e[int(i * len(e) / n)] for i in range(n)] for c, e in every.items()}
    with pytest.raises(ValueError):
        reader.sample_frames(df, "none", n)
    assert reader.sample_frames(df.limit(0), "ends", n, pad=True).count() == 0


def test_tensors(spark):
    frames = images.synthetic_clips(spark, 1, 0, frames=2)
    broken = frames.limit(1).withColumns({"h": F.lit(7), "path": F.lit("broken")})
    sample = reader.sample_frames(frames.unionByName(broken), "uniform_or_all", 2)
    out = {r["path"]: r for r in reader.tensors(sample, 16).where("place = 0").collect()}
    r = out["clip_000000.mp4"]
    assert (r["channels"], r["height"], r["width"], len(r["values"])) == (3, 16, 16, 3 * 256) and r["error"] is None
    assert out["broken"]["values"] is None and "reshape" in out["broken"]["error"]
    pixels = np.frombuffer(frames.orderBy("frame_idx").first()["pixels"], np.uint8).reshape(60, 80, 3)
    red = np.array(r["values"]).reshape(3, 16, 16)[0] * images.IMAGENET_STD[0] + images.IMAGENET_MEAN[0]
    assert red.mean() == pytest.approx(pixels[..., 2].mean() / 255, abs=1e-3)


def test_temporal_profile(spark):
    df = spark.createDataFrame([([1.0, 1.0, 2.0, 2.0, 1.0, 1.0, 0.0, 0.0],)], "a array<double>")
    w = reader.temporal_profile(F.col("a"), 4)
    r = df.select(w.alias("w"), reader.profile_entropy(w).alias("e"), reader.profile_peak(w).alias("p")).first()
    assert r["w"] == [2.0, 4.0, 2.0, 0.0] and r["p"] == 0.5 and r["e"] == pytest.approx(1.5, abs=1e-6)


def test_encoders_load_once_and_keep_broken_rows_apart(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")

        def encode(frames):
            if any(f.max() == 255 and f.min() == 255 for f in frames):
                raise RuntimeError("white")
            return np.array([[f.mean(), 1.0] for f in frames])

        return encode

    encoders.register("spy", 2, load)
    pixels = lambda v: bytes([v] * 12)
    df = spark.createDataFrame([("a", 0, 2, 2, 3, pixels(10)), ("a", 1, 2, 2, 3, pixels(30)), ("b", 0, 2, 2, 3, pixels(255)), ("c", 0, 2, 2, 3, b"x")], "path string, frame_idx int, h int, w int, c int, pixels binary").repartition(3)
    out = {(r["path"], r["frame_idx"]): r for r in encoders.encode_frames(df, "spy").collect()}
    assert out["a", 1]["vec"] == [30.0, 1.0] and out["b", 0]["error"] == "RuntimeError: white" and out["c", 0]["vec"] is None
    pids = open(log).read().split()
    assert len(pids) == len(set(pids))
    clips = {r["path"]: r["vec"] for r in encoders.encode_clips(df, "spy", renormalize=True).collect()}
    assert np.linalg.norm(clips["a"]) == pytest.approx(1) and clips["b"] == clips["c"] == [0.0, 0.0]
    texts = spark.createDataFrame([(1, "a cat sits"), (2, None), (3, "")], "path bigint, t string")
    made = {r["path"]: r["vec"] for r in encoders.encode_texts(texts, "letter_counts", "t").collect()}
    assert sum(made[1]) == 10 and made[2] is None and len(made[3]) == 64
    assert encoders.encode_clips(df.where("path = 'a'"), "channel_means").first()["vec"] is not None
    with pytest.raises(ValueError):
        encoders.encode_frames(df, "nope")


def test_kernels_that_are_loaded(spark):
    images.register("double_mean", load=lambda: (lambda f: 2 * float(f.mean())))
    images.register("pair_gap", load=lambda: (lambda a, b: float(np.abs(a.astype(int) - b).max())), pairs=True)
    frames = images.synthetic_clips(spark, 2, 0, frames=3)
    out = images.score_frames(frames, {"m": "double_mean"})
    assert out.where("error is not null or m <= 0").count() == 0
    broken = frames.withColumn("h", F.when(F.col("path") == "clip_000001.mp4", 7).otherwise(F.col("h")))
    pairs = images.score_pairs(broken, "pair_gap")
    assert pairs.where("error is null").select("path").distinct().count() == 1 and pairs.where("error is not null and magnitude is null").count() == 2
    jittered = images.jitter_frames(broken)
    assert jittered.where("pixels is null and error is not null").count() == 3 and jittered.where("error is null").count() == 3
    with pytest.raises(ValueError):
        images.register("x")


def test_detectors(spark):
    lum = {"steps": [10.0] * 5 + [90.0] * 5 + [10.0] * 5, "ramp": [float(8 * i) for i in range(15)], "one": [5.0]}
    df = spark.createDataFrame([(c, i, v, i * 1.0) for c, vs in lum.items() for i, v in enumerate(vs)], "path string, frame_idx int, lum double, sec double")
    count = lambda d, t: {r["path"]: r["count"] for r in scores.scene_segments(df, "path", "lum", "sec", t, d).groupBy("path").count().collect()}
    assert count("content", 27.0) == {"steps": 3, "ramp": 1, "one": 1}
    assert count("threshold", 50.0) == {"steps": 2, "ramp": 2, "one": 1}
    assert count("adaptive", 0.0) == {"steps": 3, "ramp": 1, "one": 1}
    with pytest.raises(ValueError):
        count("other", 1.0)


def grouped_vectors(n, width=32, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((max(1, n // 10), width))
    return (centre[rng.integers(0, len(centre), n)] + 0.3 * rng.standard_normal((n, width))).astype(np.float32)


def test_vector_index(spark, tmp_path):
    m = grouped_vectors(3000)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(9001, None), (9002, [0.0] * 32), (9003, [1.0])], "id bigint, vec array<float>")
    folder = str(tmp_path / "index")
    VectorIndex.create(spark, folder, rows, cell=100)
    index = VectorIndex.open(spark, folder)
    assert len(index.centres) > 16 and len(index) == 3000
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = u @ u.T
    np.fill_diagonal(sims, -9)
    asked = rows.where("id % 50 = 0 and id < 3000")
    got = {(r["query"], r["place"]): r["id"] for r in index.search(asked, 3, None).collect()}
    exact = {(q, p + 1): int(i) for q in range(0, 3000, 50) for p, i in enumerate(np.argsort(-sims[q])[:3])}
    assert sum(got[k] == v for k, v in exact.items()) >= len(exact) - 1  # float32 may swap near-equal ones
    near = {(r["query"], r["place"]): r["id"] for r in index.search(asked, 3).collect()}
    assert sum(near.get(k) == v for k, v in exact.items()) >= 0.9 * len(exact)
    edges = {(r["query"], r["id"]) for r in index.within(asked, 0.9, None).collect()}
    assert edges == {(q, int(i)) for q in range(0, 3000, 50) for i in np.flatnonzero(sims[q] >= 0.9)}
    index.append(spark.createDataFrame([(5000, m[0].tolist())], "id bigint, vec array<float>"), 7)
    index.append(spark.createDataFrame([(5001, m[0].tolist())], "id bigint, vec array<float>"), 7)
    assert len(index) == 3001 and index.search(asked.where("id = 0"), 1).first()["id"] == 5001
    with pytest.raises(Exception, match="already exists"):
        VectorIndex.create(spark, folder, rows)
    with pytest.raises(ValueError):
        VectorIndex.create(spark, str(tmp_path / "none"), rows.limit(0))


def test_first_qualifying_distance_and_hash(spark):
    # the second item's first hash is 3 bits from the first one's second hash; its second one is equal to its first
    df = spark.createDataFrame([(0, [0xFF, 0x700]), (1, [0x000, 0xFF]), (2, None)], "ord bigint, hs array<bigint>")
    out = {r["ord"]: (r["duplicate_of"], r["score"], r["hash_str"]) for r in dedup.dedup_by_hash(df, 3).collect()}
    assert out == {0: (None, None, f"{0xFF:016x}"), 1: (0, 3, "0" * 16), 2: (None, None, None)}


def test_methods_are_compared_on_known_copies(spark):
    frames = images.synthetic_clips(spark, 6, 3, frames=4)
    hashed = images.score_frames(frames, {"h": "phash"}).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "h"))), lambda x: x["h"]).alias("hs"))
    order = {p: i for i, p in enumerate(sorted(r["path"] for r in hashed.select("path").collect()))}
    ords = spark.createDataFrame(list(order.items()), "path string, ord bigint")
    items = hashed.join(encoders.encode_clips(frames, "channel_means", renormalize=True), "path").join(ords, "path")
    truth = spark.createDataFrame([(order[f"clip_{i:06d}.mp4"], order[f"dup_{i:06d}.mp4"]) for i in range(3)], "a bigint, b bigint")
    out = {r["method"]: r for r in dedup.compare_methods(items, truth, {"phash": 10, "clip_embed": 0.99999, "lancedb": 0.99999}).collect()}
    assert set(out) == {"phash", "clip_embed", "lancedb"}
    assert out["phash"]["recall"] == 1.0 and out["phash"]["precision"] == 1.0
    assert all(r["build_time_s"] > 0 and r["tp"] + r["fn"] == 3 for r in out.values())
    assert dedup.dedup_clips(items.limit(0), "lancedb").count() == 0


def test_evaluation_bundle_and_limits(spark):
    u = np.random.default_rng(1).standard_normal((40, 8))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    kind = "path bigint, video array<double>, text array<double>, label string"
    df = spark.createDataFrame([(i, v.tolist(), v.tolist() if i % 4 else None, "ab"[i % 2]) for i, v in enumerate(u)], kind)
    out = {(r["metric"], r["label"]): r["value"] for r in metrics.evaluate(df, size=8).collect()}
    assert out["n_clips", None] == 30 and out["clip_score", None] == pytest.approx(1) and out["R@1", None] == 1.0
    assert {k[1] for k in out if k[0] == "intra_class_compactness"} == {"a", "b"}
    few = {(r["metric"], r["label"]): r["value"] for r in metrics.evaluate(df, size=8, max_clips=8).collect()}
    assert few["n_clips", None] == 6
    none = {r["metric"]: r["value"] for r in metrics.evaluate(df.withColumn("text", F.lit(None).cast("array<double>")), size=8).collect()}
    assert math.isnan(none["clip_score"]) and none["n_clips"] == 40
    assert math.isnan(metrics.frechet_distance(df, df, "video", max_clips=1)) and abs(metrics.frechet_distance(df, df, "video", max_clips=20)) < 1e-6


def test_medians_of_hot_groups(spark):
    df = spark.range(1001).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise("cold").alias("k"), ((F.col("id") * 7) % 1000).cast("double").alias("v"))
    want = {r["k"]: r["m"] for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r["k"]: r["median"] for r in metrics.medians(df, "k", "v").collect()} == want
    assert metrics.medians(df.limit(0), "k", "v").count() == 0


def test_training_batches(spark):
    df = spark.createDataFrame([(f"p{i}", "AB"[i % 2] if i else None, i, "train") for i in range(25)] + [("t", "A", 0, "test")], "path string, label string, label_idx int, split string").repartition(3)
    labels = readers.label_map(df.where("label <> 'B'"))
    assert labels == {"A": 0}
    batches = list(readers.training_batches(df, ["path", "label", "label_idx"], "train", 10, labels))
    assert [len(b) for b in batches] == [10, 10, 5] and all(isinstance(b, pa.RecordBatch) for b in batches)
    rows = [r for b in batches for r in b.to_pylist()]
    assert len({r["path"] for r in rows}) == 25 and all(r["label_number"] == (0 if r["label"] == "A" else r["label_idx"]) for r in rows)
    assert [len(b) for b in readers.training_batches(df, ["path"], "train", 10, drop_last=True)] == [10, 10]
    assert list(readers.training_batches(df.limit(0), ["path"])) == []


def test_sinks_of_one_file(spark, tmp_path):
    clips = spark.createDataFrame([("x/a.mp4", "L", "one"), ("y/a.mp4", "M", None)], "path string, label string, caption string")
    sinks.write_caption_map(clips, str(tmp_path / "c.json"), ["path"])
    assert json.loads((tmp_path / "c.json").read_text()) == {"a": "one", "M_a": "M"}
    assert "M_a\ty/a.mp4" in (tmp_path / "c.json.links").read_text()
    with pytest.raises(ValueError):
        sinks.write_caption_map(clips, str(tmp_path / "d.json"), ["path"], at_most=1)
    sinks.write_ablation({0.5: "d/b", 0.25: "d/a"}, str(tmp_path / "t.yaml"), {"model": {"dtype": "bfloat16"}})
    text = (tmp_path / "t.yaml").read_text()
    assert "ratios: [0.25, 0.5]" in text and '    - ratio: 0.25\n      video_dir: "d/a/videos"' in text and 'dtype: "bfloat16"' in text
    rows = sinks.write_scaling([(1, 100, 10.0), (4, 100, 4.0)], str(tmp_path / "s.csv"))
    assert rows[1]["speedup"] == 2.5 and rows[1]["efficiency_pct"] == 62.5
    scored = spark.createDataFrame([(None,), ("bad",), ("bad",)], "error string")
    assert sinks.write_fault_log(scored, str(tmp_path / "f.txt")) == {"processed": 3, "failed": 2}
    dedup.save_index(clips, str(tmp_path / "kept"))
    assert dedup.load_index(spark, str(tmp_path / "kept")).count() == 2
    sinks.write_maps(spark.createDataFrame([("a", 0, [2, 2], b"12345678")], "path string, frame_idx int, shape array<int>, data binary"), str(tmp_path / "maps"))
    assert spark.read.parquet(str(tmp_path / "maps")).count() == 1


def test_annotations_of_several_files_in_file_order(spark, tmp_path):
    for name, ids in (("1.csv", "ab"), ("2.csv", "cd")):
        (tmp_path / name).write_text("label,youtube_id,time_start,time_end\n" + "".join(f"A,{i},0,1\n" for i in ids))
    rows = readers.read_annotations(spark, str(tmp_path / "*.csv"), quota=3)
    assert sorted(r["youtube_id"] for r in rows.collect()) == ["a", "b", "c"]


def test_build_splits_rank_once_equals_single_mixtures(spark):
    make = lambda p, n, syn: spark.createDataFrame([(f"{p}{i}", "AB"[i % 2], syn) for i in range(n)], "path string, label string, is_synthetic boolean")
    real, synth = make("r", 40, False), make("s", 60, True)
    every = mixture.build_splits(real, synth, [0.0, 0.25, 0.5, 1.0])
    for ratio in (0.25, 0.5):
        alone = mixture.build_splits(real, synth, [ratio])
        assert rows_of(every.where(F.col("ratio") == ratio).select("path", "mix_split")) == rows_of(alone.select("path", "mix_split"))


def test_clip_transforms_fall_back(spark):
    from framewright.kernels import transforms

    frames = images.synthetic_clips(spark, 2, 0, frames=4)
    out = transforms.transform_clips(frames, "interpolation", "linear", 3)
    assert {r["path"]: r["count"] for r in out.groupBy("path").count().collect()} == {"clip_000000.mp4": 10, "clip_000001.mp4": 10}
    kept = out.where("out_idx % 3 = 0").select("path", (F.col("out_idx") / 3).cast("int").alias("frame_idx"), "pixels")
    assert kept.join(frames.select("path", "frame_idx", F.col("pixels").alias("p")), ["path", "frame_idx"]).where("pixels = p").count() == 8

    def load():
        def tool(fs, n):
            raise RuntimeError("no device")

        return tool

    transforms.register("interpolation", "net", load)
    spare = transforms.transform_clips(frames, "interpolation", "net", 2)
    assert spare.where("method = 'linear' and error = 'RuntimeError: no device'").count() == 14
    alone = transforms.transform_clips(frames, "interpolation", "net", 2, fall_back=False)
    assert alone.count() == 2 and alone.where("pixels is null and error is not null").count() == 2
    speed = {f: transforms.transform_clips(frames, "speed", "index", f).count() / 2 for f in (1.0, 2.0, 0.75)}
    assert speed == {1.0: 4, 2.0: 2, 0.75: 5}
    with pytest.raises(ValueError):
        transforms.transform_clips(frames, "speed", "other", 1.0)
    with pytest.raises(ValueError):
        transforms.register("other", "x", load)


def test_texts_are_rewritten(spark):
    from framewright.kernels import transforms

    def load():
        def rewrite(texts, n):
            if "bad" in texts:
                raise RuntimeError("refused")
            return [[f"{t} {k}" for k in range(n)] for t in texts]

        return rewrite

    transforms.register_rewriter("echo", load)
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "")], "path bigint, caption string").coalesce(1)
    assert rows_of(transforms.rewrite_texts(df, "echo", "caption", 2)) == [(1, 0, "a 0", None), (1, 1, "a 1", None), (2, None, None, "RuntimeError: refused")]
    with pytest.raises(ValueError):
        transforms.rewrite_texts(df, "none", "caption", 2)


def test_evaluation_from_frames(spark):
    from framewright.plans.evaluate import evaluate_clip, evaluate_fvd

    frames = images.synthetic_clips(spark, 6, 0, frames=2)
    dark = frames.withColumn("pixels", F.unhex(F.repeat(F.lit("00"), 60 * 80 * 3)))
    assert abs(evaluate_fvd(frames, frames, "channel_means")) < 1e-6 and evaluate_fvd(frames, dark, "channel_means") > 0.01
    assert math.isnan(evaluate_fvd(frames, frames, "channel_means", max_clips=1))
    clips = spark.createDataFrame([(f"clip_{i:06d}.mp4", "ab"[i % 2], None if i == 5 else f"caption {i}") for i in range(6)], "path string, label string, caption string")
    out = {(r["metric"], r["label"]): r["value"] for r in evaluate_clip(frames, clips, "channel_means", "letter_counts").collect()}
    assert out["n_clips", None] == 5 and -1 <= out["clip_score", None] <= 1 and 0 <= out["R@1", None] <= out["R@5", None] == 1.0
    few = {r["metric"]: r["value"] for r in evaluate_clip(frames, clips, "channel_means", "letter_counts", max_clips=2).collect()}
    assert few["n_clips"] == 2
    none = {r["metric"]: r["value"] for r in evaluate_clip(frames, clips.withColumn("caption", F.lit("")), "channel_means", "letter_counts").collect()}
    assert math.isnan(none["clip_score"]) and none["n_clips"] == 6
    encoders.register("short", 3, lambda: (lambda xs: np.zeros((len(xs), 3))))
    with pytest.raises(ValueError):
        evaluate_clip(frames, clips, "channel_means", "short")


def test_table_text(spark):
    df = spark.createDataFrame([("a", 1.23456, None), ("bb", 2.0, 3)], "name string, x double, n int")
    assert sinks.table_text(df).split("\n") == ["name      x  n", "----  -----  -", "   a  1.235   ", "  bb      2  3"]
    assert sinks.table_text(df, 1).endswith("... 1 more rows") and sinks.table_text(df.limit(0)).count("\n") == 1
