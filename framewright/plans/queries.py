"""Registered queries of the core, over whole tables. plans/sql.py holds the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions.clean import file_name, hash64, label_key, split_key, usable_score
from framewright.kernels import images
from framewright.operators import augment, bias, dedup, metrics, mixture, scores
from framewright.operators.distribute import global_rank
from framewright.operators.frames import profile_entropy, profile_peak, sample_frames
from framewright.operators.frames import temporal_profile as temporal_profile_of
from framewright.operators.vectors import VectorIndex
from framewright.plans.curate import CurationConfig, Gate, curate, stage_counts
from framewright.session import cut, new_folder, table
from framewright.streaming.incremental import arrival_stats

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

#: Thresholds of the registered sweeps.
BLUR_THRESHOLDS = [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]
QUANTITY_THRESHOLDS = [0.0, 10.0, 20.0, 30.0, 40.0]
MOTION_EDGES = [0.0, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0, 200.0]
RATIOS = [0.25, 0.5, 0.75, 1.0]
SIMILAR, HASH_DISTANCE, VECTOR = 0.3, 6, 64


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that the order of summation leaves no trace."""
    return df.select(*((F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def clips(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "clip_meta")


def latest(s: SparkSession, d: str) -> DataFrame:
    """One row per path, the one ingested last; ties are settled by content, so any engine finds the same."""
    rows = clips(s, d).select("path", label_key(F.col("label")).alias("label"), split_key(F.col("split")).alias("split"), "is_synthetic", "duration_sec", usable_score(F.col("blur_score")).alias("blur_score"), usable_score(F.col("motion_score")).alias("motion_score"), usable_score(F.col("quality_score")).alias("quality_score"), "caption", "source_path", "ingested_at")
    best = rows.groupBy("path").agg(F.max(F.struct("ingested_at", *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("blur_score", "motion_score", "quality_score")), "label", "split", "is_synthetic", "duration_sec", "caption", "source_path")).alias("r")).select("path", "r.*")
    return best.withColumns({c: F.nullif(c, F.lit(-1.0)) for c in ("blur_score", "motion_score", "quality_score")})


def real(s: SparkSession, d: str) -> DataFrame:
    return latest(s, d).where("label is not null and not coalesce(is_synthetic, false)")


def synthetic(s: SparkSession, d: str) -> DataFrame:
    return latest(s, d).where("label is not null and is_synthetic")


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def hashes(s: SparkSession, d: str) -> DataFrame:
    """Every item of dedup_result in order of arrival; hs is null without a usable hash."""
    h = table(s, d, "dedup_result").select(F.col("item_no").alias("ord"), hash64(F.col("hash_str")).alias("h")).where("ord is not null")
    return h.groupBy("ord").agg(F.min("h").alias("h")).select("ord", F.when(F.col("h").isNotNull(), F.array("h")).alias("hs"))


def frames(s: SparkSession, d: str) -> DataFrame:
    """Event series as frames of one luminance value; the user is the clip."""
    e = table(s, d, "events").select(F.col("user_id").alias("clip"), F.col("value").alias("lum"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return scores.number_frames(e, "clip", "us", "event_id")


# ---- distributions, gates, sweeps


@query
def class_distribution(s, d):
    return rounded(bias.class_distribution(latest(s, d).where("label is not null")))


@query
def pipeline_stats(s, d):
    counts = F.transform(F.map_entries("class_counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return rounded(bias.pipeline_stats(latest(s, d)).withColumn("class_counts", F.array_join(F.array_sort(counts), " ")))


@query
def label_encode(s, d):
    return mixture.label_encode(latest(s, d).select("path", "label"))


@query
def blur_filter(s, d):
    return latest(s, d).where(bias.blur_gate(40.0)).select("path", "blur_score")


@query
def motion_filter(s, d):
    return latest(s, d).where(bias.motion_gate(2.0, 80.0)).select("path", "motion_score")


@query
def bias_sweep(s, d):
    return rounded(bias.threshold_sweep(real(s, d), BLUR_THRESHOLDS))


@query
def bias_sweep_table(s, d):
    return rounded(bias.threshold_sweep_table(real(s, d), s.createDataFrame([(t,) for t in BLUR_THRESHOLDS], "threshold double")))


@query
def bias_sweep_lineitem(s, d):
    return rounded(bias.threshold_sweep(table(s, d, "lineitem").withColumn("flag", F.concat("l_returnflag", "l_linestatus")), QUANTITY_THRESHOLDS, "flag", "l_quantity"))


@query
def tvd_by_threshold(s, d):
    return rounded(bias.tvd_by_threshold(bias.threshold_sweep(real(s, d), BLUR_THRESHOLDS)))


@query
def representation_drift(s, d):
    base = bias.class_distribution(real(s, d))
    return rounded(bias.representation_drift(base, bias.class_distribution(real(s, d).where(bias.blur_gate(60.0)))))


@query
def total_variation(s, d):
    return rounded(bias.total_variation(bias.class_distribution(real(s, d)), bias.class_distribution(synthetic(s, d))))


@query
def retention_by_class(s, d):
    return rounded(bias.retention(real(s, d), bias.blur_gate(40.0)))


@query
def retention_overall(s, d):
    return rounded(bias.retention_of(real(s, d), bias.blur_gate(40.0)))


@query
def at_risk_by_drift(s, d):
    return bias.at_risk_by_drift(bias.threshold_sweep(real(s, d), BLUR_THRESHOLDS), 80.0, -0.2)


@query
def at_risk_by_retention(s, d):
    return bias.at_risk_by_retention(bias.threshold_sweep(real(s, d), BLUR_THRESHOLDS), 80.0)


@query
def recovery_analysis(s, d):
    return rounded(bias.recovery(real(s, d), synthetic(s, d), 60.0))


@query
def retention_top_n(s, d):
    return rounded(bias.most_variable_classes(rounded(bias.threshold_sweep(real(s, d), BLUR_THRESHOLDS), 9), 5))


@query
def motion_bin_retention(s, d):
    return rounded(bias.motion_bins(latest(s, d), bias.blur_gate(40.0), MOTION_EDGES))


@query
def task_quality_report(s, d):
    # means of integers are exact in either engine, so halves round alike
    rows = latest(s, d).where("label is not null").withColumns({f"{c}_centi": F.round(F.col(f"{c}_score") * 100) for c in ("blur", "motion", "quality")})
    return scores.task_report(rows.withColumn("n_chars", F.length("caption")), ["blur_centi", "motion_centi", "quality_centi", "n_chars"])


@query
def spearman_rho(s, d):
    return rounded(metrics.spearman(latest(s, d), "blur_score", "motion_score"))


@query
def duration_stats(s, d):
    rows = cut(latest(s, d).where("label is not null").select("label", "duration_sec"))
    per = rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("duration_sec").alias("mean"), F.min("duration_sec").alias("low"), F.max("duration_sec").alias("high"))
    return rounded(per.join(metrics.medians(rows, "label", "duration_sec"), "label", "left"))


# ---- splits and mixtures


@query
def per_class_quota(s, d):
    return mixture.per_class_quota(table(s, d, "orders"), "o_orderpriority", ["o_orderkey"], 25).select("o_orderkey", "o_orderpriority")


@query
def stratified_split(s, d):
    return mixture.stratified_split(real(s, d)).select("path", "label", "assigned")


def _mix(ratio: float) -> Query:
    return lambda s, d: mixture.mix(real(s, d).select("path", "label", "is_synthetic"), synthetic(s, d).select("path", "label", "is_synthetic"), ratio).select("path", "is_synthetic")


for _ratio in RATIOS:
    REGISTRY[f"mix_ratio_{round(_ratio * 100)}"] = _mix(_ratio)


@query
def mix_to_total(s, d):
    return mixture.mix_to_total(real(s, d).select("path", "is_synthetic"), synthetic(s, d).select("path", "is_synthetic"), 0.5)


@query
def mixture_stats(s, d):
    keep = ["path", "label", "is_synthetic"]
    return rounded(mixture.mixture_stats(mixture.build_splits(real(s, d).select(*keep), synthetic(s, d).select(*keep), [0.0, *RATIOS])))


@query
def choices_with_replacement(s, d):
    return mixture.choices(table(s, d, "customer").select("c_custkey"), 5000, "c_custkey").select("draw", "c_custkey")


@query
def augment_fanout(s, d):
    return augment.fan_out(real(s, d).select("path")).select("path", "aug_type", "aug_path")


# ---- frames


@query
def frame_pairs(s, d):
    return scores.frame_pairs(frames(s, d), "clip", "lum")


@query
def motion_score_events(s, d):
    pairs = scores.frame_pairs(frames(s, d), "clip", "lum").select("clip", (F.abs(F.col("b") - F.col("a")) / 10).alias("magnitude"))
    return rounded(scores.motion_scores(pairs, frames(s, d).select("clip"), "clip"))


@query
def scene_segments(s, d):
    return rounded(scores.scene_segments(frames(s, d).withColumn("sec", F.col("us") / 1e6), "clip", "lum", "sec", 150.0), 3)


@query
def dominant_scene(s, d):
    segments = scores.scene_segments(frames(s, d).withColumn("sec", F.col("us").cast("double")), "clip", "lum", "sec", 150.0)
    info = scores.scene_info(segments, "clip")
    # times are microseconds here, so the rate is tiny
    return rounded(info.withColumn("scene_change_rate", F.col("scene_change_rate") * 1e12), 3)


@query
def scene_fades(s, d):
    return rounded(scores.scene_segments(frames(s, d).withColumn("sec", F.col("us") / 1e6), "clip", "lum", "sec", 100.0, "threshold"), 3)


@query
def scene_adaptive(s, d):
    return rounded(scores.scene_segments(frames(s, d).withColumn("sec", F.col("us") / 1e6), "clip", "lum", "sec", 0.0, "adaptive"), 3)


def _sampled(rule: str, n: int, pad: bool) -> Query:
    return lambda s, d: sample_frames(frames(s, d).withColumn("fps", F.lit(30.0)), rule, n, "clip", pad, "fps", 8.0).select("clip", "place", "frame_idx", "lum")


for _rule, _n, _pad in (("uniform", 8, False), ("uniform_or_all", 64, False), ("ends", 64, True), ("stride", 8, False)):
    REGISTRY[f"frames_{_rule}"] = _sampled(_rule, _n, _pad)


@query
def temporal_profile(s, d):
    """The 64 numbers of a vector as attention over 8 places in time and 8 patches."""
    weights = temporal_profile_of(F.transform("embedding", lambda x: F.abs(x.cast("double"))), 8)
    return rounded(table(s, d, "embeddings").select("vec_id", profile_entropy(weights).alias("entropy"), profile_peak(weights).alias("peak")))


@query
def quality_flags(s, d):
    at = F.posexplode(scores.uniform_indices(F.col("total"), 8)).alias("place", "at")
    sample = frames(s, d).select("clip", "frame_idx", "lum", at).where("at = frame_idx")
    per = scores.quality_scores(sample.select("clip", F.col("place").alias("frame_idx"), F.col("lum").alias("blur"), (F.col("lum") / 4).alias("quality")), "clip", "mean", 60.0, 20.0)
    return rounded(per)


@query
def laplacian_8x8(s, d):
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    at = lambda a, r, c: F.element_at(a, (F.pmod(r, F.lit(8)) * 8 + F.pmod(c, F.lit(8)) + 1).cast("int"))
    rows = table(s, d, "embeddings").select("vec_id", v.alias("p"))
    lap = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: at(F.col("p"), F.floor(i / 8) - 1, i % 8) + at(F.col("p"), F.floor(i / 8) + 1, i % 8) + at(F.col("p"), F.floor(i / 8), i % 8 - 1) + at(F.col("p"), F.floor(i / 8), i % 8 + 1) - 4 * at(F.col("p"), F.floor(i / 8), i % 8))
    mean = F.aggregate("l", F.lit(0.0), lambda a, x: a + x) / 64
    with_mean = rows.select("vec_id", lap.alias("l")).withColumn("m", mean)
    return rounded(with_mean.select("vec_id", (F.aggregate("l", F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / 64).alias("laplacian_variance")))


@query
def noise_proxy_8x8(s, d):
    wide = table(s, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id").agg(F.greatest(F.lit(0.0), 100 - F.stddev_pop(F.col("x").cast("double"))).alias("noise_proxy"))
    return rounded(wide, 5)


def images_of(s: SparkSession, d: str) -> DataFrame:
    """Stand-in images: 64 numbers as 8 x 8 grey pixels."""
    pixel = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 128 + 128))).cast("int"))
    packed = F.unhex(F.array_join(F.transform(pixel, lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")), ""))
    return table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(0).alias("frame_idx"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"), packed.alias("pixels"))


@query
def frame_kernels(s, d):
    """The kernels that SQL can express, as score_frames runs them, all rows."""
    out = images.score_frames(images_of(s, d), {"laplacian": "laplacian", "fft": "fft", "noise": "noise_proxy", "phash": "phash", "ahash": "ahash", "whash": "whash"})
    # of 64 whole numbers the variance is a multiple of 1 / 4096, so halves would round by chance
    return rounded(out.withColumn("laplacian", F.round(F.col("laplacian") * 4096)).drop("error"), 4)


@query
def image_kernels(s, d):
    """All pixel kernels on the stand-in images, all rows."""
    out = images.score_frames(images_of(s, d), {"laplacian": "laplacian", "fft": "fft", "noise": "noise_proxy", "niqe": "niqe", "phash": "phash", "dhash": "dhash", "ahash": "ahash", "whash": "whash"})
    return rounded(out.drop("error"))


@query
def direction_entropy(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    counts = table(s, d, "events").select("user_id", F.pmod(k, F.lit(8)).alias("bin")).where("bin is not null").groupBy("user_id", "bin").agg(F.count("*").alias("n"))
    return rounded(scores.direction_entropy(counts, ["user_id"], "n"))


# ---- dedup


@query
def phash64(s, d):
    return vectors(s, d).select("ord", F.lower(F.lpad(F.hex(dedup.bit_hash(F.col("vec"))), 16, "0")).alias("phash"))


@query
def hamming_pairs(s, d):
    return dedup.hamming_edges(hashes(s, d), HASH_DISTANCE)


@query
def hash_classes(s, d):
    """Membership for hamming_pairs, which names first items only: each item with a hash, and the first of equal hash."""
    return dedup.copy_classes(hashes(s, d), "hs")


@query
def cosine_pairs(s, d):
    return rounded(dedup.cosine_edges(vectors(s, d), SIMILAR), 5)


@query
def dedup_greedy_cosine(s, d):
    v = vectors(s, d)
    return v.select("ord").join(dedup.first_wins(cut(dedup.cosine_edges(v, SIMILAR))), "ord", "left_anti")


@query
def dedup_greedy_hamming(s, d):
    h = cut(dedup.first_items(hashes(s, d), "hs"))
    return h.select("ord").join(dedup.first_wins(cut(dedup.hamming_edges(h, HASH_DISTANCE, unique=True))), "ord", "left_anti")


@query
def dedup_verdicts(s, d):
    return dedup.dedup_by_hash(hashes(s, d).select("ord", "hs"), HASH_DISTANCE).select("ord", "duplicate_of", F.col("score").alias("dist"), "is_duplicate")


@query
def dedup_two_pass(s, d):
    both = vectors(s, d).select("ord", "vec", F.array(dedup.bit_hash(F.col("vec"))).alias("hs"))
    return dedup.dedup_two_pass(both, HASH_DISTANCE, SIMILAR)


@query
def dedup_nearest(s, d):
    return rounded(dedup.dedup_by_vector(vectors(s, d).select("ord", "vec"), SIMILAR, nearest=True).select("ord", "duplicate_of", F.col("score").alias("sim")), 5)


@query
def dedup_precision_recall(s, d):
    edges = dedup.cosine_edges(vectors(s, d), SIMILAR).select(F.col("early").alias("a"), F.col("late").alias("b"))
    same = vectors(s, d).select(F.col("ord").alias("o"), "label")
    near = dedup.cosine_edges(vectors(s, d), 0.25).join(same.toDF("early", "l1"), "early").join(same.toDF("late", "l2"), "late")
    truth = near.where("l1 = l2").select(F.col("early").alias("a"), F.col("late").alias("b"))
    return dedup.pair_metrics(edges, truth)


@query
def exact_dup_md5(s, d):
    return dedup.exact_copies(table(s, d, "documents"), "doc_id", "text")


@query
def clip_hash_values(s, d):
    return clips(s, d).select("path", hash64(F.col("phash")).alias("h")).where("h is not null").distinct()


@query
def source_files(s, d):
    return clips(s, d).select(file_name(F.col("source_path")).alias("file")).where("file is not null").groupBy("file").agg(F.count("*").alias("n"))


# ---- set metrics


@query
def clip_score(s, d):
    a = vectors(s, d)
    b = a.select((F.col("ord") - 1).alias("ord"), "vec")
    return rounded(metrics.paired_score(a, b, "ord", "vec"), 5)


@query
def recall_at_k(s, d):
    # a query is the vector of the next row, so ranks are not all 1
    v = vectors(s, d).select("ord", "vec")
    shifted = v.select((F.col("ord") - 1).alias("ord"), "vec")
    return rounded(metrics.retrieval_recall(shifted, v, "ord", "vec", [1, 5, 10, 100], every=50))


@query
def intra_class_compactness(s, d):
    return rounded(metrics.compactness(vectors(s, d), "label", "vec", VECTOR), 5)


@query
def vector_mean_cov_diag(s, d):
    return rounded(metrics.mean_and_variance(vectors(s, d), "vec", VECTOR))


@query
def fvd_by_label(s, d):
    return rounded(metrics.frechet_by_group(vectors(s, d).withColumn("label", F.col("label").cast("string")), "vec", "label"), 5)


@query
def evaluation_bundle(s, d):
    """The caption vector of a clip is the vector of the next row."""
    v = vectors(s, d).withColumn("label", F.col("label").cast("string"))
    texts = v.select((F.col("ord") - 1).alias("ord"), F.col("vec").alias("text"))
    return rounded(metrics.evaluate(v.join(texts, "ord", "left").withColumnRenamed("vec", "video"), "ord", size=VECTOR, every=50), 5)


@query
def vector_index_nearest(s, d):
    """The three most similar stored vectors of every 50th, looked for in all cells."""
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    index = VectorIndex.create(s, new_folder(s, "vectors"), rows)
    return rounded(index.search(rows.where("id % 50 = 0"), 3, None).select("query", "place", "id", "sim"), 5)


@query
def topk_accuracy(s, d):
    rows = vectors(s, d).select(F.col("vec").alias("logits"), F.col("label").alias("truth"))
    return rounded(metrics.topk_accuracy(rows, "logits", "truth", [1, 5]))


@query
def best_ratio(s, d):
    results = latest(s, d).where("blur_score is not null").groupBy((F.length("label") % 5 / 4).alias("ratio")).agg(F.avg("blur_score").alias("fvd"))
    return metrics.best_ratio(results.where("ratio is not null"))


@query
def mean_frame_vectors(s, d):
    return rounded(metrics.mean_of_unit_frames(vectors(s, d).withColumn("label", F.col("label").cast("string")), "label", "vec", VECTOR).select("label", F.posexplode("vec").alias("dim", "x")), 5)


# ---- captions, prompts, export


@query
def caption_vote(s, d):
    return scores.caption_vote(table(s, d, "documents").where("clip_path is not null"), "clip_path", "doc_id")


@query
def caption_fill(s, d):
    return scores.fill_captions(latest(s, d).select("path", "label", "caption"))


@query
def prompts_from_captions(s, d):
    return augment.prompts_from_captions(latest(s, d), "kiteflying", 20, ["path"], "wide shot: ")


@query
def synthesis_plan(s, d):
    risky = bias.at_risk_by_retention(bias.threshold_sweep(real(s, d), BLUR_THRESHOLDS), 80.0)
    return augment.synthesis_plan(risky, 4, {"kiteflying": ["a kite over the sea", "a kite over a field"]})


@query
def speed_variants(s, d):
    sizes = table(s, d, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count("*").alias("n"))
    return augment.speed_variants(sizes, "clip", "n", [0.75, 1.0, 1.25])


@query
def frame_interpolation(s, d):
    return augment.interpolate_frames(frames(s, d).select("clip", "frame_idx", F.floor("lum").alias("lum")), "clip", "lum", 3)


@query
def export_captions(s, d):
    return augment.export_captions(latest(s, d).select("path", "label", "caption"), ["path"])


@query
def label_map_join(s, d):
    known = latest(s, d).where("label is not null").select("path", "label")
    return scores.with_labels(latest(s, d).select("path"), known)


@query
def resume_anti_join(s, d):
    return scores.not_yet_done(latest(s, d).select("path"), table(s, d, "motion_scores"))


@query
def motion_agreement(s, d):
    flow = table(s, d, "motion_scores").groupBy("path").agg(F.max("mean_flow_magnitude").alias("flow"))
    joined = latest(s, d).select("path", "label", "motion_score").join(flow, "path")
    return rounded(joined.groupBy("label").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("motion_score") - F.col("flow"))).alias("mean_gap")))


@query
def arrivals_by_day(s, d):
    rows = table(s, d, "dedup_result").select("arrived_at", F.col("batch_no").cast("string").alias("batch"), F.col("hamming_distance").cast("double").alias("v"))
    return rounded(arrival_stats(rows, "arrived_at", "v", "1 day", by="batch"))


# ---- the whole plan

CURATION = CurationConfig(blur=Gate(low=30.0), quality=Gate(high=50.0), motion=Gate(low=2.0, high=80.0), min_scene_duration=0.5, dedup_threshold=6)


def clip_inputs(s: SparkSession, d: str) -> DataFrame:
    """Latest clips with the order of arrival and the hash, for curate()."""
    h = clips(s, d).select("path", hash64(F.col("phash")).alias("h")).groupBy("path").agg(F.max("h").alias("h"))
    rows = cut(latest(s, d).join(h, "path").where("label is not null"))
    return global_rank(rows, [F.col("path")], "ord").withColumn("hs", F.when(F.col("h").isNotNull(), F.array("h")))


@query
def curate_flagship(s, d):
    return curate(clip_inputs(s, d), CURATION).select("path", "label", "label_idx", "blur_score", "motion_score")


@query
def curate_stage_counts(s, d):
    return stage_counts(latest(s, d).where("label is not null"), CURATION)


@query
def class_ranks(s, d):
    ranked = latest(s, d).where("label is not null").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.col("blur_score").desc_nulls_last(), "path")))
    return ranked.where("r <= 10").select("label", "path", "r")
