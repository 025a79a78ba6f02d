"""Metrics of whole sets: vector moments, Frechet distance, retrieval, compactness, accuracy, correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.dedup import dot, let, matrix
from framewright.operators.distribute import global_rank, join_unique, prefix_sum
from framewright.session import cut

NAN = float("nan")


def unit(vec: Column, epsilon: float = 1e-8) -> Column:
    """vec divided by its norm plus epsilon; a vector of zeros (a black frame may have one) stays as it is."""
    def divided(s: Column) -> Column:
        return F.transform(s["v"], lambda x: F.when(s["norm"] > 0, x / s["norm"]).otherwise(x))

    with_norm = let(vec.cast("array<double>"), lambda v: F.struct(v.alias("v"), (F.sqrt(dot(v, v)) + epsilon).alias("norm")))
    return F.when(vec.isNotNull(), let(with_norm, divided))


def mean_of_unit_frames(frames: DataFrame, clip: str, vec: str, size: int, renormalize: bool = False) -> DataFrame:
    """(clip, vec): mean of the clip's frame vectors of unit length; again of unit length with renormalize. Null vectors
    don't count, vectors of zeros do; a clip without any has zeros; vectors of another length are refused (ValueError).

    Frames that follow each other are added up before they are shuffled, so a clip that holds most frames is one row a
    run, and sums are taken over whole Arrow batches.
    """
    kind = frames.schema[clip].dataType.simpleString()
    schema = f"`{clip}` {kind}, n bigint, total array<double>"

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(vec)
            there = vectors.is_valid().to_numpy(zero_copy_only=False)
            m = np.zeros((len(batch), size))
            if there.any():
                own = matrix(vectors.filter(pa.array(there)))
                norm = np.sqrt((own * own).sum(axis=1, keepdims=True))
                m[there] = own / np.where(norm > 0, norm, 1)
            yield pa.RecordBatch.from_arrays([batch.column(clip), pa.array(there.astype(np.int64)), _lists(m)], names=[clip, "n", "total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                codes = batch.column(clip).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
                n = np.add.reduceat(batch.column("n").to_numpy(), first)
                total = np.add.reduceat(matrix(batch.column("total")), first, axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(clip).take(pa.array(first)), pa.array(n), _lists(total)], names=[clip, "n", "total"])

    parts = frames.select(clip, F.col(vec).cast("array<double>").alias(vec)).mapInArrow(lambda b: added(units(b)), schema)
    # runs that a batch border has cut meet in the last step, a few rows a clip
    runs = parts.repartition(clip).sortWithinPartitions(clip).mapInArrow(added, schema)
    sums = runs.groupBy(clip).agg(F.sum("n").alias("n"), F.collect_list("total").alias("t"))
    total = F.aggregate(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.element_at("t", 1), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    out = sums.select(clip, F.transform(total, lambda x: x / F.greatest(F.col("n"), F.lit(1))).alias("vec"))
    return out.withColumn("vec", unit(F.col("vec"))) if renormalize else out


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def moments(vectors: DataFrame, vec: str, group: list[str] | None = None) -> DataFrame:
    """(group, n, total, products): partial sums of vectors and outer products per partition, then added up.

    Each partition sends one row per group (D + D * D numbers), so the shuffle does not grow with the rows.
    Group columns are strings; null vectors are left out.
    """
    group = group or []
    kinds = dict(vectors.dtypes)
    schema = "".join(f"`{g}` {kinds[g]}, " for g in group) + "n bigint, total array<double>, products array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(g).to_pylist() for g in group), strict=True)) if group else [()] * len(batch)
            m = matrix(batch.column(vec))
            for key in set(keys):
                own = m[[k == key for k in keys]]
                n, s, p = held.get(key, (0, 0.0, 0.0))
                held[key] = (n + len(own), s + own.sum(axis=0), p + own.T @ own)
        if held:
            columns = [pa.array([k[i] for k in held]) for i in range(len(group))]
            columns += [pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1].tolist() for v in held.values()]), pa.array([v[2].ravel().tolist() for v in held.values()])]
            yield pa.RecordBatch.from_arrays(columns, names=[*group, "n", "total", "products"])

    def add(table: pa.Table) -> pa.Table:
        total, products = matrix(table.column("total")).sum(axis=0), matrix(table.column("products")).sum(axis=0)
        first = [pa.array([table.column(g)[0].as_py()], table.schema.field(g).type) for g in group]
        return pa.Table.from_arrays([*first, pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([total.tolist()]), pa.array([products.tolist()])], names=[*group, "n", "total", "products"])

    parts = vectors.where(F.col(vec).isNotNull()).select(*group, vec).mapInArrow(partial, schema)
    return parts.groupBy(*group).applyInArrow(add, schema)


def mean_and_cov(n: int, total: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample covariance of added-up moments; n is at least 2."""
    mean = np.asarray(total) / n
    d = len(mean)
    return mean, (np.asarray(products).reshape(d, d) - n * np.outer(mean, mean)) / (n - 1)


def frechet(mu1: np.ndarray, cov1: np.ndarray, mu2: np.ndarray, cov2: np.ndarray) -> float:
    """|mu1 - mu2|^2 + tr(cov1 + cov2 - 2 sqrt(cov1 cov2)), the root by symmetric eigenvalues (cut off at zero)."""

    def trace_root(a: np.ndarray, b: np.ndarray) -> float:
        values, vectors = np.linalg.eigh(a)
        root = (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
        return float(np.sqrt(np.maximum(np.linalg.eigvalsh(root @ b @ root), 0)).sum())

    diff = mu1 - mu2
    return float(diff @ diff + np.trace(cov1) + np.trace(cov2) - 2 * trace_root(cov1, cov2))


def frechet_distance(real: DataFrame, generated: DataFrame, vec: str, max_clips: int | None = None, order: str = "path") -> float:
    """Frechet distance of two sets of vectors; NaN if either has fewer than two. Two rows reach the driver. With
    max_clips only the first of each set by `order` count, as a report over a fixed number of clips asks for."""
    if max_clips is not None:
        real, generated = (df.orderBy(order).limit(max_clips) for df in (real, generated))
    sides = [moments(df, vec).first() for df in (real, generated)]
    if any(r is None or r["n"] < 2 for r in sides):
        return NAN
    return frechet(*(x for r in sides for x in mean_and_cov(r["n"], r["total"], r["products"])))


def frechet_by_group(vectors: DataFrame, vec: str, group: str, against: DataFrame | None = None) -> DataFrame:
    """(group, n, distance) of each group's vectors from all of `against` (all vectors, if not given)."""
    whole = moments(vectors if against is None else against, vec).select(F.col("n").alias("n0"), F.col("total").alias("t0"), F.col("products").alias("p0"))
    joined = moments(vectors.withColumn(group, F.col(group).cast("string")), vec, [group]).crossJoin(F.broadcast(whole))  # one row

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            values = [frechet(*mean_and_cov(r["n"], r["total"], r["products"]), *mean_and_cov(r["n0"], r["t0"], r["p0"])) if min(r["n"], r["n0"]) > 1 else NAN for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[group] for r in rows], pa.string()), pa.array([r["n"] for r in rows], pa.int64()), pa.array(values, pa.float64())], names=[group, "n", "distance"])

    return joined.mapInArrow(finish, f"`{group}` string, n bigint, distance double")


def mean_and_variance(vectors: DataFrame, vec: str, size: int) -> DataFrame:
    """(dim, mean, variance) for each place; sample variance. One aggregation, then unpivoted."""
    wide = vectors.agg(*(f(F.col(vec)[i].cast("double")).alias(f"{name}{i}") for i in range(size) for name, f in (("m", F.avg), ("v", F.var_samp))))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("variance")) for i in range(size)))).alias("x")).select("x.*")


def paired_score(a: DataFrame, b: DataFrame, key: str, vec: str) -> DataFrame:
    """One row (score): mean dot product of the vectors that share a key."""
    joined = a.select(key, F.col(vec).cast("array<double>").alias("u")).join(b.select(key, F.col(vec).cast("array<double>").alias("v")), key)
    return joined.agg(F.avg(dot(F.col("u"), F.col("v"))).alias("score"))


def retrieval_recall(queries: DataFrame, gallery: DataFrame, key: str, vec: str, ks: list[int], every: int = 1, block: int = 4096) -> DataFrame:
    """(k, recall): share of queries whose own gallery row is among the k most similar; ties count for it.

    The rank of the own row is 1 + the gallery rows that are strictly more similar. Queries are those whose
    key is divisible by `every`. The gallery is read in blocks against all query blocks: each pair of blocks
    is one matrix product, and only counts per query leave a task.
    """
    q = queries.where((F.col(key) % every == 0) & F.col(vec).isNotNull()).select(key, F.col(vec).cast("array<double>").alias("v"))
    own = q.join(gallery.select(key, F.col(vec).cast("array<double>").alias("g")), key).select(key, "v", "g")
    n_q, n_g = max(1, -(-q.count() // block)), max(1, -(-gallery.count() // block))
    null = F.lit(None).cast("array<double>")
    left = own.select(F.pmod(F.xxhash64(key), F.lit(n_q)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(n_g - 1))).alias("q"), F.lit(True).alias("asks"), F.col(key).alias("id"), "v", "g")
    right = gallery.where(F.col(vec).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("p"), F.pmod(F.xxhash64(key), F.lit(n_g)).cast("int").alias("q"), F.lit(False).alias("asks"), F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"), null.alias("g"))

    def product(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, v = table.column("id").to_numpy(), matrix(table.column("v"))
        if not asks.any() or asks.all():
            return pa.table({"id": pa.array([], pa.int64()), "better": pa.array([], pa.int64())})
        mine = matrix(table.column("g").filter(pa.array(asks)))
        level = np.einsum("ij,ij->i", v[asks], mine)
        sims = v[asks] @ v[~asks].T
        other = ids[asks][:, None] != ids[~asks][None, :]
        return pa.table({"id": ids[asks], "better": ((sims > level[:, None] + 1e-12) & other).sum(axis=1)})

    ranks = left.unionByName(right).groupBy("p", "q").applyInArrow(product, "id bigint, better bigint").groupBy("id").agg(F.sum("better").alias("better"))
    wide = ranks.agg(*(F.avg((F.col("better") < k).cast("double")).alias(f"r{k}") for k in ks))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in ks))).alias("x")).select("x.*")


def compactness(vectors: DataFrame, label: str, vec: str, size: int) -> DataFrame:
    """(label, n, compactness): mean cosine of all pairs in a class, in linear time.

    For unit vectors the pairs' sum is (|sum v|^2 - sum |v|^2) / 2. Classes of fewer than two have NaN.
    """
    v = F.col(vec).cast("array<double>")
    sums = vectors.where(F.col(vec).isNotNull()).select(F.col(label).alias("label"), v.alias("v")).groupBy("label").agg(F.count("*").alias("n"), F.sum(dot(F.col("v"), F.col("v"))).alias("own"), *(F.sum(F.col("v")[i]).alias(f"_{i}") for i in range(size)))
    square = sum((F.col(f"_{i}") * F.col(f"_{i}") for i in range(1, size)), F.col("_0") * F.col("_0"))
    value = F.when(F.col("n") < 2, F.lit(NAN)).otherwise((square - F.col("own")) / (F.col("n") * (F.col("n") - 1)))
    return sums.select("label", "n", value.alias("compactness"))


def evaluate(clips: DataFrame, key: str = "path", video: str = "video", text: str = "text", label: str = "label", size: int = 64, ks: tuple[int, ...] = (1, 5, 10), max_clips: int | None = None, every: int = 1) -> DataFrame:
    """The evaluation bundle in one frame (metric, label, value): n_clips, clip_score, R@k over all clips with both
    vectors, and intra_class_compactness by label.

    clips: key (bigint), unit vectors of the clip and of its caption, label. Clips without a caption have a null text
    vector and take no part, but count in n_clips if there is no clip with one; then clip_score is NaN and alone.
    max_clips: only the first by key. every: recall asks for the clips whose key it divides, against all.
    """
    if max_clips is not None:
        clips = clips.orderBy(key).limit(max_clips)
    clips = cut(clips.select(key, video, text, label))
    both = cut(clips.where(F.col(video).isNotNull() & F.col(text).isNotNull()))
    n = both.count()
    spark = clips.sparkSession
    row = lambda name, value: spark.createDataFrame([(name, None, float(value))], "metric string, label string, value double")
    if not n:
        return row("clip_score", NAN).unionByName(row("n_clips", clips.count()))
    score = paired_score(both.select(key, F.col(video).alias("v")), both.select(key, F.col(text).alias("v")), key, "v").select(F.lit("clip_score").alias("metric"), F.lit(None).cast("string").alias("label"), F.col("score").alias("value"))
    recall = retrieval_recall(both.select(key, F.col(text).alias("v")), both.select(key, F.col(video).alias("v")), key, "v", list(ks), every).select(F.concat(F.lit("R@"), "k").alias("metric"), F.lit(None).cast("string").alias("label"), F.col("recall").alias("value"))
    compact = compactness(both.where(F.col(label).isNotNull()), label, video, size).select(F.lit("intra_class_compactness").alias("metric"), F.col("label").cast("string").alias("label"), F.col("compactness").alias("value"))
    return row("n_clips", n).unionByName(score).unionByName(recall).unionByName(compact)


def topk_accuracy(predictions: DataFrame, logits: str, truth: str, ks: list[int]) -> DataFrame:
    """One row (n, top1, ...): share of rows whose true class (0-based) is among the k highest logits.
    Of equal logits the class that comes first is higher."""
    own = F.col(logits)[F.col(truth)]
    better = F.aggregate(F.transform(F.col(logits), lambda x, i: F.when((x > own) | ((x == own) & (i < F.col(truth))), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return predictions.withColumn("_b", better).agg(F.count("*").alias("n"), *(F.avg((F.col("_b") < k).cast("double")).alias(f"top{k}") for k in ks))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho): rank correlation with mean ranks for ties; rows with a null in either are left out.

    Ranks come from the counts of distinct values by running sums over range partitions, never from one task, and
    frequent values get theirs by broadcast.
    """
    rows = cut(df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null"))
    out = rows
    for c in ("x", "y"):
        counts = rows.groupBy(c).agg(F.count("*").alias("w"))
        ranks = prefix_sum(counts, [F.col(c)], "w", "upto").select(c, (F.col("upto") - (F.col("w") - 1) / 2.0).alias(f"r{c}"))
        out = join_unique(out, ranks, c, "inner")
    return out.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): the exact median of the values that are not null, the mean of the middle two of an even number.

    The values are ranked in one order by group and value over range partitions, so a group may hold any part of
    the rows; two ranks a group are picked out.
    """
    ranked = global_rank(df.where(F.col(value).isNotNull()).select(F.col(group).alias("_k"), F.col(value).cast("double").alias("_v")), [F.col("_k"), F.col("_v")], "_g")
    sizes = cut(ranked.groupBy("_k").agg(F.min("_g").alias("_g0"), F.count("*").alias("_n")))
    wanted = sizes.select("_k", F.explode(F.array_distinct(F.array(F.col("_g0") + F.floor((F.col("_n") - 1) / 2), F.col("_g0") + F.floor(F.col("_n") / 2)))).alias("_g"))
    return ranked.select("_g", "_v").join(wanted, "_g").groupBy(F.col("_k").alias(group)).agg(F.avg("_v").alias("median"))


def best_ratio(results: DataFrame, ratio: str = "ratio", fvd: str = "fvd") -> DataFrame:
    """One row (best_ratio): the ratio of least distance; NaN distances do not win, ties go to the lower ratio."""
    usable = results.where(F.col(fvd).isNotNull() & ~F.isnan(fvd))
    return usable.agg(F.min(F.struct(F.col(fvd).alias("f"), F.col(ratio).alias("r"))).alias("x")).select(F.col("x.r").alias("best_ratio"))


def evaluate_ratios(clips: DataFrame, ratio: str, vec: str, real: DataFrame) -> DataFrame:
    """(ratio, n, distance) of the vectors of each mixture from the real ones, for best_ratio()."""
    return frechet_by_group(clips, vec, ratio, real)


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "r") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
