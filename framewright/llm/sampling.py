"""Problem 5: a sample whose category shares match targets, by systematic sampling with unequal probabilities."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.clean import label_key
from framewright.operators.distribute import global_rank, prefix_sum
from framewright.session import cut

#: The sample has this part of all distinct paths.
SAMPLE_PART = 4
#: Inclusion probabilities are whole multiples of 1 / UNIT, so that sums over any partitions are exact;
#: they are decimals, as the sum is the sample's size times UNIT.
UNIT = 1 << 40


def _keyed(targets: DataFrame) -> DataFrame:
    return targets.select("target_id", label_key(F.col("label")).alias("key"), F.col("is_synthetic").alias("syn"), "share_bp", "min_rows").where("target_id is not null")


def target_report(clips: DataFrame, targets: DataFrame, part: int = SAMPLE_PART) -> DataFrame:
    """target_id, needed, available, take, met: what each target asks for and what there is.

    needed is the greater of min_rows and share_bp * S / 10000 rounded up, S the distinct paths / part rounded
    down. available are the distinct paths with the target's label (label_key) and is_synthetic; a null in
    either fits no target, a null share_bp or min_rows asks for nothing. The clips are aggregated by category
    before anything is joined, so a hot category is no hot task.
    """
    size = clips.agg(F.floor(F.countDistinct("path") / part).cast("bigint").alias("s"))
    members = clips.select("path", label_key(F.col("label")).alias("key"), F.col("is_synthetic").alias("syn")).where("path is not null and key is not null and syn is not null")
    available = members.distinct().groupBy("key", "syn").agg(F.count("*").alias("available"))
    asked = _keyed(targets).join(F.broadcast(size))
    share = F.expr("(coalesce(share_bp, 0) * s + 9999) div 10000")
    asked = asked.select("target_id", "key", "syn", F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), share).alias("needed"), share.alias("by_share"), "min_rows")
    out = asked.join(available, ["key", "syn"], "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
    return out.select("target_id", "key", "syn", "needed", "by_share", "available", F.least("needed", "available").alias("take"), (F.col("available") >= F.col("needed")).alias("met"))


def start_of(seed: str) -> int:
    """The random start, one of UNIT equally likely places: 40 bits of the seed's md5."""
    return int(hashlib.md5(f"{seed}:start".encode()).hexdigest()[:10], 16) % UNIT


def draw(clips: DataFrame, report: DataFrame, seed: str) -> DataFrame:
    """(path, target_id, key, syn, take, u, drawn) of every path that fits a target: whether the systematic pass draws
    it. report: as of target_report. A path that fits several targets stands under the first only."""
    members = clips.select("path", label_key(F.col("label")).alias("key"), F.col("is_synthetic").alias("syn")).where("path is not null and key is not null and syn is not null").distinct()
    frame = members.join(F.broadcast(report.where("take > 0")), ["key", "syn"]).groupBy("path").agg(F.min(F.struct("target_id", "by_share", "available", "take", "key", "syn")).alias("t"))
    frame = frame.select("path", "t.*").withColumn("p", F.expr(f"cast((cast(least(by_share, available) as decimal(19, 0)) * {UNIT}L) div available as decimal(38, 0))"))
    frame = frame.withColumn("u", F.md5(F.concat_ws(":", F.lit(seed), "path")))
    summed = prefix_sum(frame, [F.col("target_id"), F.col("u"), F.col("path")], "p", "upto")
    passed = lambda c: F.expr(f"({c} + {start_of(seed)}L) div {UNIT}L")
    return cut(summed.select("path", "target_id", "key", "syn", "take", "u", (passed("upto") > passed("upto - p")).alias("drawn")))


def repaired(drawn: DataFrame) -> DataFrame:
    """(path, target_id) of the sample: what the pass drew, and for targets that have too few or too many of them the
    first `take` in their order, drawn ones first."""
    per = drawn.groupBy("target_id").agg(F.count_if("drawn").alias("have"), F.count("*").alias("all"), F.first("take").alias("take"))
    off = cut(per.where("have <> least(take, all)").select("target_id", "have"))
    good = drawn.join(F.broadcast(off), "target_id", "left_anti").where("drawn")
    # drawn paths first, then the others, both in random order: the first `take` of each target
    mend = drawn.join(F.broadcast(off), "target_id")
    ranked = global_rank(mend, [F.col("target_id"), F.col("drawn").desc(), F.col("u"), F.col("path")], "r")
    first = ranked.groupBy("target_id").agg(F.min("r").alias("r0"))
    mended = ranked.join(F.broadcast(first), "target_id").where("r - r0 < take")
    return good.select("path", "target_id").unionByName(mended.select("path", "target_id"))


def sample(clips: DataFrame, targets: DataFrame, seed: str = "mixture") -> DataFrame:
    """(path, target_id): the drawn paths; a target gets `take` of its report.

    Within the sorted targets the paths are in random order (a hash of seed and path). Each has the inclusion
    probability by_share / available of its target (1 at most); probabilities are summed up across range
    partitions, and a path is drawn where the running sum, moved by one random start, passes a whole number.
    Floors are repaired afterwards: a target that lacks rows gets the undrawn paths that come first in its
    random order, one that has a row too many gives back its last. A path that fits several targets is drawn
    for the first only.
    """
    return repaired(draw(clips, cut(target_report(clips, targets)), seed))


def fulfilment(clips: DataFrame, targets: DataFrame, seed: str = "mixture") -> DataFrame:
    """(target_id, needed, available, drawn, short) of each target: what the sample of this seed gave it, and whether
    its category holds too few paths. A target is short if its category, as the systematic pass found it, was used up
    before `needed`; targets of one category share its paths, and are judged each against all of them."""
    report = cut(target_report(clips, targets))
    drawn = draw(clips, report, seed)
    got = repaired(drawn).groupBy("target_id").agg(F.count("*").alias("drawn"))
    reached = drawn.groupBy("key", "syn").agg(F.count("*").alias("reached"))
    out = report.select("target_id", "key", "syn", "needed", "available").join(reached, ["key", "syn"], "left").join(got, "target_id", "left")
    out = out.withColumns({"drawn": F.coalesce("drawn", F.lit(0)), "reached": F.coalesce("reached", F.lit(0))})
    # a category that no target takes anything from isn't walked: only targets that need nothing, or find nothing, have it
    return out.select("target_id", "needed", "available", "drawn", ((F.col("reached") < F.col("needed")) & (F.col("drawn") < F.col("needed"))).alias("short"))


def short_targets(clips: DataFrame, targets: DataFrame) -> DataFrame:
    """target_id of the targets for which fewer paths are available than needed, as the sample leaves them."""
    return fulfilment(clips, targets).where("short").select("target_id")
