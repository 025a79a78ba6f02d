"""Operators against small tables with known answers, and against sequential models."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright import schema
from framewright.functions.clean import file_name, hash64, label_key, split_key, usable_score
from framewright.kernels import images
from framewright.operators import augment, bias, dedup, metrics, mixture, scores, segments
from framewright.operators.distribute import global_rank, join_unique, prefix_sum
from framewright.plans import queries
from framewright.plans.curate import CurationConfig, Gate, curate, stage_counts
from framewright.plans.queries import CURATION, REGISTRY, latest
from framewright.session import cut


def clip_rows(spark, rows):
    return spark.createDataFrame(rows, "path string, label string, is_synthetic boolean, blur_score double, motion_score double")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cleaning(spark):
    df = spark.createDataFrame([(" 0xFF\n", "valid ", "Kite_ Flying-", " ./a//b/../c\\d.mp4 ", math.nan), ("0", "Test", " _", "../x", -1.0), ("f" * 17, "?", None, "", 0.0), (None, None, "x", "/a/./b", None)], "h string, s string, l string, p string, v double")
    out = df.select(hash64(F.col("h")), split_key(F.col("s")), label_key(F.col("l")), file_name(F.col("p")), usable_score(F.col("v"))).collect()
    assert [tuple(r) for r in out] == [(255, "val", "kiteflying", "a/c/d.mp4", None), (None, "test", None, "../x", None), (None, None, None, None, 0.0), (None, None, "x", "/a/b", None)]
    assert spark.createDataFrame([("F" * 16,)], "h string").select(hash64(F.col("h"))).first()[0] == -1


@pytest.mark.parametrize("parts", [1, 5])
def test_rank_and_prefix_sum_do_not_depend_on_partitions(spark, parts):
    df = spark.range(200).select(F.pmod(F.col("id") * 7919, F.lit(201)).alias("k"), F.lit(2).cast("bigint").alias("w")).repartition(parts)
    ranks = {r["k"]: r["rank"] for r in global_rank(df, [F.col("k")]).collect()}
    assert ranks == {k: i for i, k in enumerate(sorted(ranks))}
    assert {r["k"]: r["upto"] for r in prefix_sum(df, [F.col("k")], "w").collect()} == {k: 2 * (i + 1) for k, i in ranks.items()}
    assert global_rank(df.limit(0), [F.col("k")]).count() == 0


def test_join_unique_with_a_hot_key(spark):
    big = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 3 == 0, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    assert rows_of(join_unique(big, small, "k").groupBy("v").count()) == [(1, 20000), (2, 1), (None, 9999)]


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a.mp4", "A", 0, "train", False, 1.0, 30.0, 2, 2, 1.0, 1.0, 1.0, None, None, None)], schema.MANIFEST_SCHEMA)
    schema.write_manifest(df.coalesce(1), str(tmp_path / "m"))
    assert '"caption":null' in next((tmp_path / "m").glob("*.json")).read_text()
    assert schema.read_manifest(spark, str(tmp_path / "m"), schema.MANIFEST_SCHEMA).collect() == df.collect()
    assert schema.read_manifest_or_empty(spark, str(tmp_path / "none")).count() == 0
    schema.validate_manifest(df)
    assert schema.load_strict(spark, str(tmp_path / "m"), schema.MANIFEST_SCHEMA).count() == 1
    schema.write_manifest(df.withColumn("fps", F.lit(None).cast("double")), str(tmp_path / "lacking"))
    with pytest.raises(schema.ManifestError, match="a.mp4: fps"):
        schema.load_strict(spark, str(tmp_path / "lacking"), schema.MANIFEST_SCHEMA)
    with pytest.raises(schema.ManifestError):
        schema.validate_manifest(df.drop("path"))
    assert schema.missing_fields(df.withColumn("fps", F.lit(None).cast("double"))).first()["missing"] == ["fps"]


CLIPS = [("a1", "A", False, 10.0, 1.0), ("a2", "A", False, 90.0, 5.0), ("b1", "B", False, 90.0, 100.0), ("b2", "B", False, None, None)]


def test_gates_and_distributions(spark):
    df = clip_rows(spark, CLIPS)
    assert rows_of(df.where(bias.blur_gate(50.0)).select("path")) == [("a2",), ("b1",), ("b2",)]
    assert df.where(bias.blur_gate(0.0)).count() == 4 and df.where(bias.blur_gate(-1.0)).count() == 4
    assert rows_of(df.where(bias.motion_gate(2.0, 80.0)).select("path")) == [("a2",), ("b2",)]
    base = bias.class_distribution(df)
    half = bias.class_distribution(df.where("label = 'A'"))
    assert rows_of(bias.representation_drift(base, half)) == [("A", 1.0), ("B", -1.0)]
    assert bias.total_variation(base, half).first()["tvd"] == 0.5
    assert bias.total_variation(base, base).first()["tvd"] == 0.0
    assert math.isnan(bias.retention_of(df, bias.blur_gate(1.0), "none").first()[0])
    assert bias.class_distribution(df.limit(0)).count() == 0
    assert bias.pipeline_stats(df.limit(0)).count() == 0


def test_sweep_forms_agree_and_a_full_gate_gives_half(spark):
    df = clip_rows(spark, CLIPS[:3])
    sweep = bias.threshold_sweep(df, [0.0, 50.0, 1000.0])
    assert rows_of(bias.threshold_sweep_table(df, spark.createDataFrame([(0.0,), (50.0,), (1000.0,)], "threshold double"))) == rows_of(sweep)
    rows = {(r["threshold"], r["class"]): r for r in sweep.collect()}
    assert rows[0.0, "A"]["retention_rate"] == 1 and rows[0.0, "A"]["tvd"] == 0
    assert rows[1000.0, "A"]["drift"] == -1 and rows[1000.0, "A"]["tvd"] == 0.5
    assert rows_of(bias.at_risk_by_retention(sweep, 1000.0)) == [("A",), ("B",)]


def test_recovery(spark):
    out = bias.recovery(clip_rows(spark, CLIPS), clip_rows(spark, [("s", "C", True, 0.0, 0.0)]), 50.0)
    assert {r["class"]: round(r["delta"], 6) for r in out.collect()} == {"A": round(1 / 4 - 1 / 3, 6), "B": round(2 / 4 - 2 / 3, 6), "C": 0.25}


@pytest.mark.parametrize(("n", "sizes"), [(1, (1, 0, 0)), (2, (1, 1, 0)), (12, (9, 1, 2))])
def test_stratified_split_sizes(spark, n, sizes):
    df = clip_rows(spark, [(f"p{i}", "A", False, 0.0, 0.0) for i in range(n)])
    counts = {r["assigned"]: r["count"] for r in mixture.stratified_split(df).groupBy("assigned").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "val", "test")) == sizes


def test_mixtures(spark):
    real = clip_rows(spark, [(f"r{i}", "A", False, 0.0, 0.0) for i in range(10)])
    synth = clip_rows(spark, [(f"s{i}", "A", True, 0.0, 0.0) for i in range(20)])
    assert mixture.mix(real, synth, 0.0).where("is_synthetic").count() == 0
    assert mixture.mix(real, synth, 0.5).groupBy("is_synthetic").count().count() == 2
    assert mixture.mix(real, synth, 0.5).where("is_synthetic").count() == 10
    whole = mixture.mix(real, synth, 1.0)
    assert whole.count() == 10 and whole.where("not is_synthetic").count() == 0
    assert mixture.mix(real, synth.limit(3), 1.0).count() == 3
    assert mixture.mix(real, synth.limit(0), 1.0).count() == 0
    assert mixture.mix(real, synth.limit(3), 0.5).where("is_synthetic").count() == 3
    assert mixture.mix_to_total(real, synth.limit(4), 0.5).where("is_synthetic").count() == 10
    with pytest.raises(ValueError):
        mixture.build_splits(real.limit(0), synth, [0.5])
    one, four = (rows_of(mixture.mix(real.repartition(n), synth.repartition(n), 0.5).select("path")) for n in (1, 4))
    assert one == four


def test_label_encode(spark):
    df = clip_rows(spark, [("1", "b", False, 0.0, 0.0), ("2", "a", False, 0.0, 0.0), ("3", None, False, 0.0, 0.0)])
    assert {r["path"]: r["label_idx"] for r in mixture.label_encode(df).collect()} == {"1": 1, "2": 0, "3": -1}


def scan(n, edges):
    near = {}
    for a, b in edges:
        near.setdefault(b, set()).add(a)
    kept = set()
    for i in range(n):
        if not near.get(i, set()) & kept:
            kept.add(i)
    return kept


@pytest.mark.parametrize(("seed", "one_task"), [(0, 200_000), (1, 0), (2, 20)])
def test_first_wins_is_the_scan_in_order(spark, monkeypatch, seed, one_task):
    monkeypatch.setattr(dedup, "ONE_TASK", one_task)
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    df = spark.createDataFrame(sorted(edges), "early bigint, late bigint")
    assert {r[0] for r in dedup.first_wins(df).collect()} == set(range(40)) - scan(40, edges)
    assert dedup.first_wins(df.limit(0)).count() == 0


def test_dedup_by_hash_with_copies_nulls_and_chains(spark):
    # 0 ~ 1, 1 ~ 2, not 0 ~ 2: 0 and 2 stay. 3 copies 1, 4 has no hash, 5 copies 2
    rows = [(0, [0b1111]), (1, [0b1100]), (2, [0b0]), (3, [0b1100]), (4, None), (5, [0b0])]
    df = spark.createDataFrame(rows, "ord bigint, hs array<bigint>")
    out = {r["ord"]: (r["duplicate_of"], r["is_duplicate"]) for r in dedup.dedup_by_hash(df, 2).collect()}
    assert out == {0: (None, False), 1: (0, True), 2: (None, False), 3: (0, True), 4: (None, False), 5: (2, True)}
    with pytest.raises(ValueError):
        dedup.dedup_clips(df, "nope")


def test_hamming_edges_are_exact(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(12)]
    hashes = [b ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(9))) for b in base for _ in range(5)]
    df = spark.createDataFrame([(i, [h]) for i, h in enumerate(hashes)], "ord bigint, hs array<bigint>")
    first = [i for i, h in enumerate(hashes) if hashes.index(h) == i]  # copies count as their first item
    truth = {(i, j, (hashes[i] ^ hashes[j]).bit_count()) for i in first for j in first if i < j and (hashes[i] ^ hashes[j]).bit_count() <= 7}
    assert {tuple(r) for r in dedup.hamming_edges(df, 7).collect()} == truth


@pytest.mark.parametrize(("distance", "held", "task_hashes"), [(0, 4_000_000, 100), (6, 4_000_000, 250_000), (6, 3, 2000), (10, 20, 4000), (63, 4_000_000, 250_000)])
def test_close_pairs_are_exact_and_come_once(spark, monkeypatch, distance, held, task_hashes):
    monkeypatch.setattr(segments, "HELD", held)
    monkeypatch.setattr(segments, "TASK_HASHES", task_hashes)
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1, 1 << 63, rng.getrandbits(20)]
    near = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for b in base for _ in range(12)}
    hashes = sorted(x - (1 << 64) if x >> 63 else x for x in near)
    truth = [(a, b) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance]
    df = spark.createDataFrame([(x,) for x in hashes], "h bigint")
    assert sorted(tuple(r) for r in segments.close_pairs(df, distance, len(hashes)).collect()) == truth
    assert segments.close_pairs(df.limit(0), distance, 0).count() == 0


def test_hash_searches_send_no_keys_through_the_driver(spark, tmp_path, monkeypatch):
    # Spark takes exploded keys for as few as the hashes, and a small file for a small table
    monkeypatch.setattr(segments, "BROADCAST_KEYS", 1000)
    monkeypatch.setattr(dedup, "BROADCAST_MEMBERS", 100)
    rng = random.Random(5)
    hashes = [rng.getrandbits(63) for _ in range(200)]
    spark.createDataFrame([(i, [h, h ^ 3]) for i, h in enumerate(hashes)], "ord bigint, hs array<bigint>").write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    h = items.selectExpr("explode(hs) as h").distinct()
    for df in (dedup.hamming_edges(items, 6), segments.close_hashes(h, h, 6, 400)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dedup_greedy_hamming", "dedup_verdicts"])
def test_hash_queries_broadcast_nothing_exploded(spark, tiny, monkeypatch, name):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(dedup, "BROADCAST_MEMBERS", 10, raising=False)
    monkeypatch.setattr(dedup, "cut", seen)
    monkeypatch.setattr(queries, "cut", seen)
    assert REGISTRY[name](spark, tiny).count()
    assert any("explode" in p for p in plans) and not any("Broadcast" in p and "explode" in p for p in plans)


def test_keys_lengthen_with_the_rows_and_lose_nothing(spark):
    assert [segments.layout(n, 6)[1] for n in (10**3, 10**5, 10**6, 10**7, 10**8)] == sorted(segments.layout(n, 6)[1] for n in (10**3, 10**5, 10**6, 10**7, 10**8))
    for n in (10**5, 10**7, 10**9):
        cut_, agree = segments.layout(n, 6)
        assert math.comb(cut_, agree) * n / 2 ** (64 * agree / cut_) < 1000  # candidates of a hash
    rng = random.Random(1)
    a = [rng.getrandbits(63) for _ in range(30)]
    b = [x ^ sum(1 << k for k in rng.sample(range(63), rng.randrange(4, 9))) for x in a]
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "h bigint")
    truth = {(x, y) for x in a for y in b if (x ^ y).bit_count() <= 6}
    for rows in (30, 2_000_000, 100_000_000):
        assert {tuple(r) for r in segments.close_hashes(df(a), df(b), 6, rows).collect()} == truth


def test_stored_index_is_opened_as_it_was_made(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(200)]
    near = [x ^ sum(1 << k for k in rng.sample(range(63), 6)) for x in base]
    df = lambda xs, at: spark.createDataFrame([(x, at + i) for i, x in enumerate(xs)], "h bigint, no bigint")
    folder = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        segments.SegmentIndex.open(spark, folder)
    made = segments.SegmentIndex.create(spark, folder, 6, rows=200)
    assert made.probe(df(near, 1000)).count() == 0
    made.append(df(base, 0), 1)
    for rows in (10, 2_000_001):  # whatever else the process that opens it works on
        monkeypatch.setattr(segments, "BROADCAST_KEYS", rows)
        assert segments.SegmentIndex.open(spark, folder).probe(df(near, 1000)).select("no").distinct().count() == 200
    with pytest.raises(FileExistsError):
        segments.SegmentIndex.create(spark, folder, 6)
    again = segments.SegmentIndex.open(spark, folder)
    size = again.rows().count()
    again.append(df(base, 0), 1)
    assert again.rows().count() == size  # the repeated batch replaced itself
    again.append(df(near[:9], 500), 2)
    assert again.hashes().count() == 209 and again.probe(df(near, 1000), before=2).count() == 200
    again.append(df([], 0), 2)
    assert again.hashes().count() == 200
    again.settings["rows"] = 1  # far outgrown
    monkeypatch.setattr(segments, "layout", lambda rows, d: (d + 3, 3))
    assert again.grow() and not again.grow()
    reopened = segments.SegmentIndex.open(spark, folder)
    assert reopened.kind == (9, 3) and reopened.probe(df(near, 1000)).select("no").distinct().count() == 200


def test_cosine_edges_in_blocks(spark):
    m = np.random.default_rng(0).standard_normal((50, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "ord bigint, vec array<double>")
    truth = {(i, j) for i in range(50) for j in range(i + 1, 50) if m[i] @ m[j] >= 0.5}
    assert {(r[0], r[1]) for r in dedup.cosine_edges(df, 0.5, block=16).collect()} == truth
    assert {(r[0], r[1]) for r in dedup.cosine_edges_sql(df, 0.5).collect()} == truth


def test_pair_metrics(spark):
    pairs = lambda *x: spark.createDataFrame(list(x), "a int, b int")
    assert tuple(dedup.pair_metrics(pairs((1, 2), (3, 4)), pairs((2, 1), (5, 6))).first()) == (1, 1, 1, 0.5, 0.5, 0.5)
    assert tuple(dedup.pair_metrics(pairs((1, 2)).limit(0), pairs((1, 2)).limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0)


def test_image_kernels():
    sharp, flat = np.zeros((100, 100), np.uint8), np.full((100, 100), 128, np.uint8)
    sharp[::2, ::2] = 255
    assert images.laplacian_variance(sharp) > images.laplacian_variance(flat) == 0
    assert images.fft_energy(sharp) > images.fft_energy(flat)
    assert images.niqe_proxy(flat) == 100 and images.noise_proxy(flat) == 100
    a, b = np.zeros((64, 64, 3), np.uint8), np.zeros((64, 64, 3), np.uint8)
    a[20:40, 20:40], b[20:40, 28:48] = 200, 200
    assert images.frame_difference(a, a) == 0
    assert images.frame_difference(a, b) == pytest.approx(320 * 200 / 4096 / 10, rel=1e-3)
    noise = np.random.default_rng(0).integers(0, 256, (64, 64, 3)).astype(np.uint8)
    for f in (images.phash, images.dhash, images.ahash, images.whash):
        assert f(noise) == f(noise.copy())
        assert (f(noise) ^ f(a)) != 0
    assert np.array_equal(images.adjust_color(noise), noise)
    assert images.flow_statistics(np.ones((4, 4, 2)))["mean"] == pytest.approx(math.sqrt(2))


def test_frames_through_spark(spark):
    frames = images.synthetic_clips(spark, 4, 2, frames=4)
    scored = images.score_frames(frames, {"blur": "laplacian", "h": "phash"})
    assert scored.where("error is not null").count() == 0 and scored.count() == 24
    assert images.score_frames(frames.withColumn("h", F.lit(7)), {"blur": "laplacian"}).where("error is not null").count() == 24
    hs = scored.groupBy("path").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    items = global_rank(hs, [F.col("path")], "ord")
    dups = dedup.dedup_by_hash(items, 10).where("is_duplicate")
    assert {r["path"] for r in dups.collect()} == {"dup_000000.mp4", "dup_000001.mp4"}
    assert images.score_pairs(frames).count() == 18
    assert images.jitter_frames(frames).count() == 24
    with pytest.raises(ValueError):
        images.score_frames(frames, {"x": "nope"})


def test_scores_of_clips_without_frames(spark):
    frames = spark.createDataFrame([("a", 0, 50.0, 10.0), ("a", 9, 0.0, 99.0), ("b", 0, None, None)], "path string, frame_idx int, blur double, quality double")
    out = {r["path"]: tuple(r)[1:] for r in scores.quality_scores(frames).collect()}
    assert out == {"a": (50.0, 10.0, False, False, True, 1), "b": (0.0, 100.0, True, True, False, 0)}
    m = scores.motion_scores(spark.createDataFrame([("a", 4.0)], "path string, magnitude double"), spark.createDataFrame([("a",), ("z",)], "path string"))
    assert {r["path"]: (r["is_static"], r["passed"]) for r in m.collect()} == {"a": (False, True), "z": (True, False)}
    with pytest.raises(ValueError):
        scores.quality_scores(frames, agg="mode")


def test_speed_and_interpolation(spark):
    sizes = spark.createDataFrame([("c", 10)], "clip string, n bigint")
    counts = {r["factor"]: r["count"] for r in augment.speed_variants(sizes, "clip", "n", [1.0, 0.75, 1.25]).groupBy("factor").count().collect()}
    assert counts == {0.75: 13, 1.25: 8}
    frames = spark.createDataFrame([("c", 0, 0), ("c", 1, 9)], "clip string, frame_idx int, v bigint")
    assert [r["v"] for r in augment.interpolate_frames(frames, "clip", "v", 3).orderBy("out_idx").collect()] == [0, 3, 6, 9]


def test_captions(spark):
    df = spark.createDataFrame([("c", 0, "A cat."), ("c", 1, "a cat"), ("c", 2, "a cat sits"), ("c", 3, ""), ("d", 0, None), ("e", 0, "One."), ("e", 1, "one")], "clip string, turn int, text string")
    assert rows_of(scores.caption_vote(df, "clip", "turn")) == [("c", "a cat sits"), ("e", "One.")]
    clips = spark.createDataFrame([("x/a.mp4", "L_M", ""), ("y/a.mp4", None, "own")], "path string, label string, caption string")
    assert rows_of(scores.fill_captions(clips).select("caption")) == [("a person performing l m",), ("own",)]
    assert rows_of(augment.export_captions(clips, ["path"])) == [("x/a.mp4", "a", "L_M"), ("y/a.mp4", "_a", "own")]


def test_hamming_pairs_with_membership_link_every_copy(spark, tmp_path):
    h = [0xF0F0, 0xF0F0, 0xF0F1, None, 0xF0F1, 0xFF00FF00FF00]
    spark.createDataFrame([(i, None if x is None else f"{x:x}") for i, x in enumerate(h)], "item_no bigint, hash_str string").write.parquet(str(tmp_path / "dedup_result.parquet"))
    first = dict(rows_of(REGISTRY["hash_classes"](spark, str(tmp_path))))
    assert first == {0: 0, 1: 0, 2: 2, 4: 2, 5: 5}
    pairs = {(a, b) for a, b, _ in rows_of(REGISTRY["hamming_pairs"](spark, str(tmp_path)))}
    close = {(i, j) for i, a in enumerate(h) for j, b in enumerate(h) if i < j and None not in (a, b) and bin(a ^ b).count("1") <= 6}
    assert {(i, j) for i in first for j in first if i < j and (first[i] == first[j] or tuple(sorted((first[i], first[j]))) in pairs)} == close


def test_quality_flags_sample_the_whole_clip(spark, tmp_path):
    lum = {1: [100.0] * 8 + [float(i) for i in range(8, 50)], 2: [60.0, 70.0, 80.0]}
    rows = [(u * 100 + i, u, float(v), datetime(2025, 1, 1, 0, 0, i)) for u, vs in lum.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, value double, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["clip"]: r for r in REGISTRY["quality_flags"](spark, str(tmp_path)).collect()}
    for u, vs in lum.items():
        picked = [vs[int(i * len(vs) / 8)] for i in range(8)]
        assert math.isclose(got[u]["blur_score"], sum(picked) / 8, abs_tol=1e-6) and math.isclose(got[u]["quality_score"], sum(picked[:4]) / 16, abs_tol=1e-6)
        assert got[u]["n_frames_sampled"] == 8
    assert got[1]["is_blurry"] and not got[1]["passed"]


def test_long_captions_vote(spark, tmp_path):
    long = "a cat sits " * 30
    spark.createDataFrame([(0, "c", "a cat"), (1, "c", long), (2, "d", long), (3, None, "x")], "doc_id bigint, clip_path string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(REGISTRY["caption_vote"](spark, str(tmp_path))) == [("c", long), ("d", long)]


def test_every_known_label_is_used(spark, tiny):
    known = latest(spark, tiny).where("label is not null").select("path", "label")
    got = REGISTRY["label_map_join"](spark, tiny)
    assert known.exceptAll(got).count() == 0
    assert got.join(known, "path", "left_anti").where("label is null or not contains(path, concat(label, '/'))").count() == 0


def test_set_metrics(spark):
    m = np.random.default_rng(42).standard_normal((50, 8))
    df = spark.createDataFrame([(i, v.tolist(), str(i % 2)) for i, v in enumerate(m)], "id bigint, vec array<double>, g string")
    assert abs(metrics.frechet_distance(df, df, "vec")) < 1e-6
    shifted = df.withColumn("vec", F.transform("vec", lambda x: x + 1))
    assert metrics.frechet_distance(df, shifted, "vec") == pytest.approx(8, abs=1e-6)
    assert math.isnan(metrics.frechet_distance(df.limit(1), df, "vec"))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    units = spark.createDataFrame([(i, v.tolist(), "a" if i < 49 else "b") for i, v in enumerate(u)], "id bigint, vec array<double>, label string")
    assert metrics.paired_score(units, units, "id", "vec").first()[0] == pytest.approx(1)
    sims = u[:49] @ u[:49].T
    out = {r["label"]: r["compactness"] for r in metrics.compactness(units, "label", "vec", 8).collect()}
    assert out["a"] == pytest.approx(sims[np.triu_indices(49, 1)].mean()) and math.isnan(out["b"])
    recall = {r["k"]: r["recall"] for r in metrics.retrieval_recall(units, units, "id", "vec", [1, 60]).collect()}
    assert recall == {1: 1.0, 60: 1.0}


def test_rank_correlation_with_ties(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (2.0, 1.0), (4.0, 0.5), (None, 1.0)], "x double, y double")
    assert tuple(metrics.spearman(df, "x", "y").first()) == (4, pytest.approx(-0.9486832980505138))


def test_curate(spark):
    rows = [(0, "a", "A", 90.0, 5.0, 10.0, 2.0, [1]), (1, "b", "A", 90.0, 5.0, 10.0, 2.0, [1]), (2, "c", "B", 1.0, 5.0, 10.0, 2.0, [7 << 40]), (3, "d", "B", 90.0, 5.0, 10.0, 2.0, None)]
    df = spark.createDataFrame(rows, "ord bigint, path string, label string, blur_score double, motion_score double, quality_score double, duration_sec double, hs array<bigint>")
    assert rows_of(curate(df, CurationConfig(dedup_threshold=3)).select("path", "label_idx")) == [("a", 0), ("d", 1)]
    assert curate(df, CurationConfig(blur=Gate(enabled=False), dedup=False)).count() == 4
    assert curate(df, CurationConfig(), score_only=True).count() == 4


def test_scene_stage(spark):
    lum = {"long": [0.0] * 2 + [200.0] * 8, "short": [0.0, 200.0] * 3}
    rows = [(c, i, v, i * 0.1) for c, vs in lum.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "path string, frame_idx int, lum double, sec double")
    info = scores.scene_info(scores.scene_segments(df, "path", "lum", "sec", 150.0), "path")
    trimmed = scores.trim_to_dominant(df, info, "path", "sec", CURATION.min_scene_duration)
    assert rows_of(trimmed.select("path", "frame_idx")) == [("long", i) for i in range(2, 10)]
    clips = info.select("path", F.col("dominant_scene_duration_sec").alias("duration_sec"), F.lit(90.0).alias("blur_score"), F.lit(5.0).alias("motion_score"), F.lit(1.0).alias("quality_score"))
    assert tuple(stage_counts(clips, CURATION).first()) == (2, 1, 1, 1)


def test_stream_dedup_continues_from_the_index(spark, tmp_path):
    from framewright.streaming.incremental import dedup_stream

    kind = "ord bigint, hs array<bigint>"
    src = tmp_path / "in"
    spark.createDataFrame([(0, [1]), (1, [3]), (2, [255 << 20])], kind).coalesce(1).write.json(str(src))
    run = lambda: dedup_stream(spark.readStream.schema(kind).json(str(src)), str(tmp_path / "index"), str(tmp_path / "cp"), 1).awaitTermination()
    run()
    spark.createDataFrame([(3, [255 << 20]), (4, [1 << 50 | 15])], kind).coalesce(1).write.mode("append").json(str(src))
    run()
    assert sorted(r["ord"] for r in spark.read.parquet(str(tmp_path / "index" / "clips")).collect()) == [0, 2, 4]


def test_readers(spark, tmp_path):
    from framewright.sources import readers, sinks

    for name in ("a.mp4", "b.MOV", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert readers.list_clips(spark, str(tmp_path)).count() == 2
    (tmp_path / "ann.csv").write_text("label,youtube_id,time_start,time_end\nA,x,0,1\nA,y,0,1\nB,z,0,1\n")
    assert [r["youtube_id"] for r in readers.read_annotations(spark, str(tmp_path / "ann.csv"), "train", quota=1).orderBy("pos").collect()] == ["x", "z"]
    (tmp_path / "list.txt").write_text("A/v.avi 1\n\nB/w.avi 2\n")
    assert rows_of(readers.read_split_list(spark, str(tmp_path / "list.txt"), ["B"])) == [("B/w.avi", "B")]
    sinks.write_template({"a": {"b": 1}, "c": "x"}, str(tmp_path / "t.yaml"))
    assert (tmp_path / "t.yaml").read_text() == 'a:\n  b: 1\nc: "x"\n'
    with pytest.raises(ValueError):
        sinks.write_mixtures(spark.range(1), "x", "nope")
