"""Order-preserving near-duplicate removal: similarity edges, greedy first-wins, indexes, method comparison."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.distribute import hot_keys, join_unique
from framewright.operators.segments import close_pairs, hamming
from framewright.session import cut

HAMMING_THRESHOLD = 10
COSINE_THRESHOLD = 0.97
#: Open edges that one task scans (16 bytes each).
ONE_TASK = 200_000
#: Hashes of items that meet the pairs by broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_MEMBERS = 100_000


def hamming_edges(hashes: DataFrame, threshold: int = HAMMING_THRESHOLD, unique: bool = False) -> DataFrame:
    """(early, late, dist): pairs of items of which any two hashes differ in at most `threshold` bits.

    hashes: ord (bigint, order of arrival), hs (array<bigint>, hashes of the frames in order); a null or empty array
    matches nothing. dist is that of the first pair within the threshold, in order of the later item's hashes and then
    of the earlier one's, which need not be the least. Exact (segments.close_pairs): the keys lengthen with the number of hashes. Items with equal
    arrays count as their first one; copy_classes names the others. unique: the caller has taken these out already.
    """
    firsts = hashes.select("ord", "hs") if unique else first_items(hashes.select("ord", "hs"), "hs")
    members = firsts.select("ord", F.posexplode("hs").alias("at", "h")).where(F.col("h").isNotNull())
    members = cut(members.groupBy("ord", "h").agg(F.min("at").alias("at")))
    distinct = cut(members.select("h").distinct())
    n, held = distinct.count(), members.count()
    near = close_pairs(distinct, threshold, n)
    if held > n:  # else no two items have a hash in common
        near = near.unionByName(distinct.select(F.col("h").alias("a"), F.col("h").alias("b")))
    near = near.withColumn("dist", hamming(F.col("a"), F.col("b")))
    # Spark's own guess is made from the table that the hashes come from, so the number decides
    how = "broadcast" if held <= BROADCAST_MEMBERS else "merge"
    x, y = (members.select(F.col("ord").alias(o), F.col("h").alias(h), F.col("at").alias(f"{o}_at")).hint(how) for o, h in (("x", "a"), ("y", "b")))
    pairs = near.join(x, "a").join(y, "b").where("x <> y")
    order = F.when(F.col("x") > F.col("y"), F.struct(F.col("x_at").alias("new"), F.col("y_at").alias("old"), "dist")).otherwise(F.struct(F.col("y_at").alias("new"), F.col("x_at").alias("old"), "dist"))
    return pairs.groupBy(F.least("x", "y").alias("early"), F.greatest("x", "y").alias("late")).agg(F.min(order)["dist"].alias("dist"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of number lists of one length as a matrix, without Python objects."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 0))
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(flat), -1)


def cosine_edges(vectors: DataFrame, threshold: float = COSINE_THRESHOLD, normalize: bool = False, block: int = 2048) -> DataFrame:
    """(early, late, sim): pairs whose dot product reaches the threshold; exact, by products of blocks.

    vectors: ord (bigint), vec (array of numbers). normalize divides by the norms first. Rows are dealt to
    blocks of about `block` rows and each pair of blocks is one task's matrix product, so memory stays bounded
    and no row pairs are shuffled; work is quadratic, which the exact definition asks for (the approximate
    form is an index over cells). Null vectors match nothing.
    """
    rows = vectors.where("vec is not null").select("ord", F.col("vec").cast("array<double>").alias("vec"))
    n = max(1, -(-rows.count() // block))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("ord"), F.lit(n)).cast("int"))
    # each row goes to the block pairs (min, max) that its block is part of
    others = F.sequence(F.lit(0), F.lit(n - 1))
    sent = rows.withColumn("o", F.explode(others)).select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "ord", "vec")

    def product(table: pa.Table) -> pa.Table:
        b, order = table.column("b").to_numpy(), table.column("ord").to_numpy()
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        m = matrix(table.column("vec"))
        if normalize:
            m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        left, right = np.flatnonzero(b == p), np.flatnonzero(b == q)
        sims = m[left] @ m[right].T
        i, j = np.nonzero(sims >= threshold)
        x, y = order[left[i]], order[right[j]]
        keep = x < y if p == q else x != y
        return pa.table({"early": np.minimum(x, y)[keep], "late": np.maximum(x, y)[keep], "sim": sims[i, j][keep]})

    return sent.groupBy("p", "q").applyInArrow(product, "early bigint, late bigint, sim double")


def cosine_edges_sql(vectors: DataFrame, threshold: float, key: str = "ord", vec: str = "vec") -> DataFrame:
    """The same as one declarative join, for small tables and as a check."""
    a = vectors.select(F.col(key).alias("early"), F.col(vec).cast("array<double>").alias("u"))
    b = vectors.select(F.col(key).alias("late"), F.col(vec).cast("array<double>").alias("v"))
    return a.join(b, F.col("early") < F.col("late")).withColumn("sim", dot(F.col("u"), F.col("v"))).where(F.col("sim") >= threshold).select("early", "late", "sim")


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def first_wins(edges: DataFrame) -> DataFrame:
    """(ord): items that a scan in order rejects, because an earlier item that was kept is similar.

    This is the lexicographically first maximal independent set, found in rounds: items without an earlier
    open neighbour are kept, their later neighbours rejected. Rounds are as many as the longest chain of
    decisions; each works on the edges that are still open, cut by checkpoint. Once these are at most ONE_TASK, a single
    task scans them in order, which decides the same. edges should be cut.
    """
    open_ = edges.select(F.col("early").cast("bigint").alias("early"), F.col("late").cast("bigint").alias("late")).distinct()
    parts: list[DataFrame] = []
    while open_.limit(ONE_TASK + 1).count() > ONE_TASK:
        open_ = open_ if parts else cut(open_)
        late = open_.select(F.col("late").alias("ord")).distinct()
        kept = open_.select(F.col("early").alias("ord")).distinct().join(late, "ord", "left_anti")
        lost = cut(open_.join(kept.withColumnRenamed("ord", "early"), "early", "left_semi").select(F.col("late").alias("ord")).distinct())
        parts.append(lost)
        # every later neighbour of a kept item is lost, so its edges go with these
        open_ = cut(open_.join(lost.withColumnRenamed("ord", "early"), "early", "left_anti").join(lost.withColumnRenamed("ord", "late"), "late", "left_anti"))
    parts.append(cut(open_.repartition(1).sortWithinPartitions("late", "early").mapInArrow(_scan, "ord bigint")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scan over edges in order of their later items."""
    lost: set[int] = set()
    for batch in batches:
        for early, late in zip(batch.column("early").to_pylist(), batch.column("late").to_pylist(), strict=True):
            if early not in lost:
                lost.add(late)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(lost), pa.int64())], names=["ord"])


def dedup(items: DataFrame, edges: DataFrame, nearest: bool = False, weight: str | None = None) -> DataFrame:
    """items with is_duplicate, duplicate_of (ord of the kept item) and score (the edge's weight).

    items: ord and any columns. duplicate_of is the first kept similar item before it or, with nearest, the
    most similar one (ties: the first).
    """
    edges = cut(edges)
    lost = first_wins(edges)
    value = F.col(weight) if weight else F.lit(None).cast("double")
    to_kept = edges.withColumn("w", value).join(lost.withColumnRenamed("ord", "early"), "early", "left_anti").join(lost.withColumnRenamed("ord", "late"), "late", "left_semi")
    best = F.max(F.struct(F.col("w"), -F.col("early"), F.col("w").alias("s"))) if nearest else F.min(F.struct(F.col("early"), F.col("w").alias("s")))
    of = to_kept.groupBy(F.col("late").alias("ord")).agg(best.alias("x"))
    named = of.select("ord", (-F.col("x")[f"{'col2' if nearest else 'early'}"] if nearest else F.col("x.early")).alias("duplicate_of"), F.col("x.s").alias("score"))
    return items.join(named, "ord", "left").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())


def copy_classes(items: DataFrame, *content: str) -> DataFrame:
    """(ord, first): each item and the first item of equal content; items without content are left out."""
    keyed = items.where(" and ".join(f"{c} is not null" for c in content)).select("ord", F.sha2(F.to_json(F.struct(*content)), 256).alias("_c"))
    classes = cut(keyed.groupBy("_c").agg(F.min("ord").alias("first"), F.count("*").alias("n")))
    several = classes.where("n > 1")
    copies = join_unique(keyed, several.drop("n"), "_c", "inner", hot_keys(classes, "_c", "n")).select("ord", "first")
    return copies.unionByName(classes.where("n = 1").select(F.col("first").alias("ord"), "first"))


def first_items(items: DataFrame, *content: str) -> DataFrame:
    """The first item of each content. Greedy dedup keeps no other: copies are rejected with it or because of it. Items
    of no other columns than ord and content come out of one aggregation."""
    if set(items.columns) == {"ord", *content}:
        return items.where(" and ".join(f"{c} is not null" for c in content)).groupBy(*content).agg(F.min("ord").alias("ord")).select(*items.columns)
    firsts = copy_classes(items, *content).where("ord = first").select("ord")
    return items.join(firsts, "ord", "left_semi")


def _with_copies(items: DataFrame, classes: DataFrame, verdicts: DataFrame, same: float) -> DataFrame:
    """Verdicts of first items, carried over to their copies: a copy's reason is its first item if that was kept."""
    v = verdicts.where("duplicate_of is not null").select(F.col("ord").alias("first"), F.col("duplicate_of").alias("_of"), F.col("score").alias("_s"))
    full = join_unique(classes, v, "first", "left")
    copy = F.col("ord") > F.col("first")
    named = full.select("ord", F.when(copy, F.coalesce("_of", "first")).otherwise(F.col("_of")).alias("duplicate_of"), F.when(copy & F.col("_of").isNull(), F.lit(same)).otherwise(F.col("_s")).alias("score"))
    return items.join(named, "ord", "left").withColumn("is_duplicate", F.col("duplicate_of").isNotNull())


def dedup_by_hash(items: DataFrame, threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """items: ord, hs. The first kept item with any frame pair within the threshold wins. Items with equal
    hashes enter the search once, so a group of copies may hold any part of the rows. hash_str is the item's first
    hash as 16 hex digits."""
    hashes = cut(items.select("ord", "hs"))
    classes = cut(copy_classes(hashes, "hs"))
    firsts = cut(first_items(hashes, "hs"))
    out = _with_copies(items, classes, dedup(firsts.select("ord"), hamming_edges(firsts, threshold, unique=True), weight="dist"), 0)
    return out.withColumn("hash_str", F.lower(F.lpad(F.hex(F.try_element_at("hs", F.lit(1))), 16, "0")))


def dedup_by_vector(items: DataFrame, threshold: float = COSINE_THRESHOLD, normalize: bool = False, nearest: bool = False) -> DataFrame:
    """items: ord, vec. The first kept item (or the nearest) with dot product >= threshold wins."""
    return dedup(items, cosine_edges(items.select("ord", "vec"), threshold, normalize), nearest, weight="sim")


def dedup_two_pass(items: DataFrame, hamming_threshold: int, cosine_threshold: float) -> DataFrame:
    """Hashes first, vectors of the survivors afterwards; (ord, stage) of the rejected items, stage 1 or 2."""
    items = cut(items.select("ord", "hs", "vec"))
    first = dedup_by_hash(items.select("ord", "hs"), hamming_threshold).where("is_duplicate").select("ord", F.lit(1).alias("stage"))
    first = cut(first)
    left = items.join(first.select("ord"), "ord", "left_anti")
    second = first_wins(cut(cosine_edges(left.select("ord", "vec"), cosine_threshold))).withColumn("stage", F.lit(2))
    return first.unionByName(second)


def by_vector_index(items: DataFrame, threshold: float, probes: int | None = 16) -> DataFrame:
    """items: ord, vec. The most similar kept item before, with cosine >= threshold, as a vector index finds it: every
    item asks the cells near it, so pairs can be missed; probes None asks all cells and misses none."""
    from framewright.operators.vectors import VectorIndex
    from framewright.session import new_folder

    rows = cut(items.where("vec is not null").select(F.col("ord").alias("id"), F.col("vec").cast("array<float>").alias("vec")))
    if rows.isEmpty():
        return dedup(items, items.select(F.col("ord").alias("early"), F.col("ord").alias("late"), F.lit(0.0).alias("sim")).limit(0), True, weight="sim")
    index = VectorIndex.create(items.sparkSession, new_folder(items.sparkSession, "vectors"), rows)
    near = index.within(rows, threshold, probes).where("id < query").select(F.col("id").alias("early"), F.col("query").alias("late"), "sim")
    return dedup(items, near, True, weight="sim")


#: Methods by name: (items, threshold) -> items with verdicts.
METHODS: dict[str, Callable[[DataFrame, float], DataFrame]] = {
    **{name: lambda items, t: dedup_by_hash(items, int(t)) for name in ("phash", "dhash", "ahash", "whash")},
    "clip_embed": lambda items, t: dedup_by_vector(items, t),
    "lancedb": lambda items, t: by_vector_index(items, t),
}


def dedup_clips(items: DataFrame, method: str, threshold: float | None = None) -> DataFrame:
    """items: ord and hs (hash methods, hashes of that method) or vec. Unknown methods are refused."""
    if method not in METHODS:
        raise ValueError(f"unknown dedup method: {method}")
    default = COSINE_THRESHOLD if method in ("clip_embed", "lancedb") else HAMMING_THRESHOLD
    return METHODS[method](items, default if threshold is None else threshold)


def pair_metrics(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) of unordered pairs (a, b), rounded to 4; empty sides give 0."""
    canon = lambda df, name: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(name, F.lit(1))
    both = canon(detected, "d").join(canon(truth, "t"), ["a", "b"], "full")
    counts = both.agg(F.count_if((F.col("d") == 1) & (F.col("t") == 1)).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("d").isNull()).alias("fn"))
    return with_scores(counts)


def with_scores(counts: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return counts.withColumns({"precision": F.bround(p, 4), "recall": F.bround(r, 4), "f1": F.bround(f1, 4)})


def save_index(kept: DataFrame, path: str, mode: str = "append") -> None:
    """Keep the accepted items (path, hs, vec, ...) as Parquet; later batches read it and append."""
    kept.write.mode(mode).parquet(path)


def load_index(spark, path: str) -> DataFrame:
    """The items that were saved; an index that does not exist is refused by Spark (PATH_NOT_FOUND)."""
    return spark.read.parquet(path)


def compare_methods(items: DataFrame, truth: DataFrame, methods: dict[str, float]) -> DataFrame:
    """(method, tp, fp, fn, precision, recall, f1, build_time_s, avg_query_ms): each method's verdicts over the same
    items against known pairs.

    items: ord, hs, vec; truth: a, b (ord of each); methods: name -> threshold. A detected pair is an item and the one
    that it is a duplicate of. Times are those of the whole run, the second per item.
    """
    items = cut(items)
    n = max(1, items.count())
    rows = []
    for name, threshold in methods.items():
        began = time.perf_counter()
        verdicts = cut(dedup_clips(items, name, threshold).where("is_duplicate").select(F.col("ord").alias("a"), F.col("duplicate_of").alias("b")))
        took = time.perf_counter() - began
        r = pair_metrics(verdicts, truth).first()
        rows.append((name, *r, round(took, 3), round(1000 * took / n, 3)))
    return items.sparkSession.createDataFrame(rows, "method string, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double, build_time_s double, avg_query_ms double")


def exact_copies(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, digest, first_key, is_copy): rows whose content equals that of a smaller key, by md5 of the bytes."""
    digests = rows.select(F.col(key).alias("key"), F.md5(F.col(content).cast("binary")).alias("digest")).where(F.col(content).isNotNull())
    firsts = digests.groupBy("digest").agg(F.min("key").alias("first_key"))
    return join_unique(digests, firsts, "digest", "inner").withColumn("is_copy", F.col("key") > F.col("first_key"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often `use` and its lambdas mention it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bit_hash(vec: Column) -> Column:
    """64-bit hash of 64 coefficients: a bit is set where a coefficient is above their median; the first is the highest bit."""

    def bits(x: Column) -> Column:
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        return F.aggregate(x["values"], none, lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(F.when(v > x["median"], one).otherwise(none)))

    def with_median(x: Column) -> Column:
        return let(F.struct(x["values"].alias("values"), ((F.element_at(x["ordered"], 32) + F.element_at(x["ordered"], 33)) / 2).alias("median")), bits)

    values = F.transform(vec, lambda x: x.cast("double"))
    return let(values, lambda v: let(F.struct(v.alias("values"), F.array_sort(v).alias("ordered")), with_median))
