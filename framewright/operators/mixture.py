"""Stratified splits, real/synthetic mixtures, quotas and label numbers, all in md5 order of a seed.

Draws depend on (seed, key) only, so results are the same for every partitioning and can be repeated in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.order import index_below, shuffle_key
from framewright.operators.distribute import global_rank, join_unique, small
from framewright.session import cut


def per_class_quota(rows: DataFrame, label: str, order: list[str], quota: int, classes: list[str] | None = None) -> DataFrame:
    """The first `quota` rows of each class in the given order (of these classes only, if given).

    The limit is applied in every partition before the shuffle (window group limit), so a hot class stays small.
    """
    kept = rows if classes is None else rows.where(F.col(label).isin(classes))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    return kept.withColumn("_r", rank).where(F.col("_r") <= quota).drop("_r")


def class_ranks(clips: DataFrame, label: str, key: str, seed: int, salt: str) -> DataFrame:
    """clips with r (0-based random rank within the class) and n (size of the class).

    The ranks come from one global order by (class, md5), so a class may hold any part of the rows.
    """
    ordered = global_rank(clips.withColumn("_u", shuffle_key(seed, salt, key)), [F.col(label), F.col("_u"), F.col(key)], "_g")
    sizes = cut(ordered.groupBy(label).agg(F.min("_g").alias("_g0"), F.count("*").alias("n")))
    return ordered.join(small(sizes.withColumnRenamed(label, "_l")), F.col(label).eqNullSafe(F.col("_l"))).withColumn("r", F.col("_g") - F.col("_g0")).drop("_u", "_g", "_g0", "_l")


def stratified_split(clips: DataFrame, label: str = "label", key: str = "path", train: float = 0.75, val: float = 0.10, seed: int = 42) -> DataFrame:
    """clips with `assigned`: per class max(1, int(train * n)) rows train, then max(1, int(val * n)) val, the rest test."""
    ranked = class_ranks(clips, label, key, seed, "split")
    n_train = F.greatest(F.lit(1), F.floor(F.col("n") * train))
    n_val = F.greatest(F.lit(1), F.floor(F.col("n") * val))
    assigned = F.when(F.col("r") < n_train, "train").when(F.col("r") < n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("assigned", assigned).drop("r", "n")


def synthetic_needed(n_real: int, ratio: float) -> int:
    """How many synthetic rows a ratio strictly between 0 and 1 adds (halves to even)."""
    return round(n_real * ratio / (1 - ratio))


def mix(real: DataFrame, synthetic: DataFrame, ratio: float, key: str = "path", seed: int = 42) -> DataFrame:
    """Real rows and so many synthetic ones that they make up `ratio` of the whole, as far as there are any.

    ratio <= 0: real only. ratio >= 1: as many synthetic draws with replacement as there are real rows, or all
    synthetic rows once if there are fewer. Between: the first synthetic rows in md5 order, each once.
    """
    if ratio <= 0:
        return real
    n_real = real.count()
    if ratio >= 1:
        n_synth = synthetic.count()
        return choices(synthetic, n_real, key, seed) if n_synth >= n_real else synthetic
    return first_ranked(real, mix_order(synthetic, key, seed), synthetic_needed(n_real, ratio))


def mix_order(synthetic: DataFrame, key: str, seed: int) -> DataFrame:
    """synthetic with _g, the place of each row in the order in which mixtures take them."""
    return global_rank(synthetic.withColumn("_u", shuffle_key(seed, "mix", key)), [F.col("_u"), F.col(key)], "_g").drop("_u")


def first_ranked(real: DataFrame, ranked: DataFrame, take: int) -> DataFrame:
    return real.unionByName(ranked.where(F.col("_g") < take).drop("_g"), allowMissingColumns=True)


def mix_to_total(real: DataFrame, synthetic: DataFrame, ratio: float, key: str = "path", seed: int = 42) -> DataFrame:
    """The loader's rule: round(n / (1 - ratio)) - n synthetic rows; if there are too few they are tiled, and of
    the tiles a sample without replacement is drawn. ratio <= 0: real only; ratio >= 1 is refused."""
    if ratio <= 0:
        return real
    if ratio >= 1:
        raise ValueError("ratio must be below 1")
    n_real, n_synth = real.count(), synthetic.count()
    need = round(n_real / (1 - ratio)) - n_real
    if not n_synth or not need:
        return real
    tiles = -(-need // n_synth)
    tiled = synthetic.withColumn("_tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    ranked = global_rank(tiled.withColumn("_u", shuffle_key(seed, "tile", key, "_tile")), [F.col("_u"), F.col(key), F.col("_tile")], "_g")
    return real.unionByName(ranked.where(F.col("_g") < need).drop("_u", "_g", "_tile"), allowMissingColumns=True)


def choices(rows: DataFrame, k: int, key: str = "path", seed: int = 42, salt: str = "choice") -> DataFrame:
    """k draws with replacement, with the column draw (0..k-1). No rows give no draws."""
    ranked = global_rank(rows, [F.col(key)], "_g")
    n = rows.count()
    if not n or k <= 0:
        return ranked.drop("_g").withColumn("draw", F.lit(0).cast("bigint")).limit(0)
    draws = rows.sparkSession.range(k).select(F.col("id").alias("draw"), index_below(F.lit(n), seed, salt, "id").alias("_g"))
    return join_unique(draws, ranked, "_g", "inner").drop("_g")


def build_splits(real: DataFrame, synthetic: DataFrame, ratios: list[float], label: str = "label", key: str = "path", train: float = 0.75, val: float = 0.10, seed: int = 42) -> DataFrame:
    """All mixtures in one frame with the columns ratio and mix_split: one stratified split of the real clips for
    all ratios, val and test always real, train mixed. No real clips: ValueError."""
    if real.isEmpty():
        raise ValueError("the real manifest has no clips")
    split = cut(stratified_split(real, label, key, train, val, seed))
    drop = lambda df: df.drop("assigned", "draw")
    trains = drop(split.where("assigned = 'train'"))
    between = [r for r in ratios if 0 < r < 1]
    # counted and ranked once for all ratios
    n_train = trains.count()
    ranked = mix_order(synthetic, key, seed) if between else None
    parts = []
    for ratio in ratios:
        mixed = drop(first_ranked(trains, ranked, synthetic_needed(n_train, ratio)) if ratio in between else mix(trains, synthetic, ratio, key, seed))
        parts.append(mixed.withColumns({"ratio": F.lit(float(ratio)), "mix_split": F.lit("train")}))
        held = split.where("assigned <> 'train'").withColumns({"ratio": F.lit(float(ratio)), "mix_split": F.col("assigned")})
        parts.append(drop(held))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def mixture_stats(mixtures: DataFrame) -> DataFrame:
    """(ratio, mix_split, n, synth_pct) of each mixture."""
    synth = F.coalesce(F.col("is_synthetic"), F.lit(False)).cast("int")
    return mixtures.groupBy("ratio", "mix_split").agg(F.count("*").alias("n"), (F.avg(synth) * 100).alias("synth_pct"))


def label_numbers(clips: DataFrame, label: str = "label") -> DataFrame:
    """(label, label_idx): 0-based places of the sorted distinct labels. Only labels are ordered, not clips."""
    labels = clips.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    return labels.withColumn("label_idx", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1).cast("int"))


def label_encode(clips: DataFrame, label: str = "label") -> DataFrame:
    """clips with label_idx; a null label has -1."""
    numbers = label_numbers(clips, label).withColumnRenamed("label", label)
    return join_unique(clips.drop("label_idx"), numbers, label).withColumn("label_idx", F.coalesce("label_idx", F.lit(-1)))
