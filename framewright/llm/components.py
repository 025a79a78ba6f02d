"""Groups of clips that are tied by their source files: connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.clean import file_name
from framewright.operators.distribute import HOT_ROWS, join_unique
from framewright.session import cut


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame):
    """The number of edges, and sums of two hashes of them: equal for equal sets."""
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("bigint"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (u, v); comp is the smallest node of the component.

    Large-star and small-star rounds: each node's neighbours are attached to its smallest neighbour, so the
    rounds needed grow with the logarithm of the size, not with the length of chains. Minima are aggregated
    before the shuffle and hot nodes are joined by broadcast; neighbours are never gathered in a list.
    Loops and nulls are left out; no edges give no rows.
    """
    now = cut(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while state["n"]:
        seen = state
        # so few edges hold no hot node; otherwise they are counted
        hot = [] if 2 * state["n"] <= HOT_ROWS else None
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _smallest(both).select("u", F.least("u", "m").alias("m"))
        large = cut(join_unique(both, least, "u", "inner", hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = _smallest(large)
        joined = join_unique(large, least, "u", "inner", hot)
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        now = cut(small.where("u <> v").distinct())
        state = _state(now)
        if state == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def tied_clips(clips: DataFrame) -> DataFrame:
    """(path, comp) for each distinct path: clips with the same comp are tied by source_path.

    Two clips are tied if one's source_path names the other's path or both name one file; ties carry over.
    source_path is compared in one spelling (file_name), letter case counts; null or blank sources tie
    nothing. Only clips that are themselves named as a source are links between files; all others just look
    up their file's group, so leaves never enter the rounds. Rows without a path are left out.
    """
    named = clips.select("path", file_name(F.col("source_path")).alias("src")).where("path is not null")
    named = cut(named.distinct())
    files = named.select(F.col("src").alias("file")).where("file is not null").distinct()
    files = cut(files)
    links = named.where("src is not null").join(files.withColumnRenamed("file", "path"), "path", "left_semi")
    many = named.where("src is not null").groupBy("path").agg(F.min("src").alias("s0"), F.max("src").alias("s1")).where("s0 <> s1")
    more = named.join(many.select("path", "s0"), "path").where("src is not null and src <> s0").select(F.col("src").alias("u"), F.col("s0").alias("v"))
    groups = cut(components(links.select(F.col("path").alias("u"), F.col("src").alias("v")).unionByName(more)))
    group_of = files.join(groups.withColumnRenamed("node", "file"), "file", "left").select("file", F.coalesce("comp", "file").alias("comp"))
    group_of = cut(group_of)
    source = named.groupBy("path").agg(F.min("src").alias("src"))
    by_source = join_unique(source, group_of.select(F.col("file").alias("src"), F.col("comp").alias("c1")), "src")
    by_self = by_source.join(group_of.select(F.col("file").alias("path"), F.col("comp").alias("c2")), "path", "left")
    return by_self.select("path", F.coalesce("c1", "c2", "path").alias("comp"))
