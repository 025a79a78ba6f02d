"""Problem 3: splits that keep related clips together, by a min-cost flow over bundles of groups."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.clean import label_key, split_key
from framewright.llm.components import tied_clips
from framewright.operators.distribute import global_rank, join_unique
from framewright.session import cut

#: Penalty of a row beyond a label's quota in a split, and beyond the split's own quota.
LABEL_COST, SPLIT_COST = 1, 64
#: Label profiles of groups that the flow tells apart.
MOST_BUNDLES = 50_000


def torn_groups(clips: DataFrame) -> DataFrame:
    """path of each clip whose group of tied clips stands in more than one of train, val and test.

    clips: path, source_path, split. Clips with a null split belong to their group and add no split.
    """
    tied = cut(tied_clips(clips))
    marks = clips.where("path is not null").groupBy("path").agg(F.bit_or(
        F.when(split_key(F.col("split")) == "train", 1).when(split_key(F.col("split")) == "val", 2).when(split_key(F.col("split")) == "test", 4).otherwise(0)
    ).alias("m"))
    masks = tied.join(marks, "path").groupBy("comp").agg(F.bit_or("m").alias("m"))
    torn = masks.where(F.bit_count("m") > 1).select("comp", F.lit(True).alias("torn"))
    return join_unique(tied, torn, "comp", "inner").select("path")


class Flow:
    """Min-cost flow by successive shortest paths with potentials; nodes are any hashable values."""

    def __init__(self) -> None:
        self.arcs: list[list] = []  # [to, left, cost]; arc i and i ^ 1 are each other's reverse
        self.out: dict = {}

    def arc(self, a, b, capacity: int, cost: int) -> int:
        self.out.setdefault(a, []).append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out.setdefault(b, []).append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def send(self, source, sink) -> None:
        number = {node: i for i, node in enumerate(self.out)}
        height = dict.fromkeys(self.out, 0)
        while True:
            far, via, heap = {source: 0}, {}, [(0, number[source], source)]
            done = set()
            while heap:
                d, _, node = heapq.heappop(heap)
                if node in done:
                    continue
                done.add(node)
                for i in self.out[node]:
                    to, left, cost = self.arcs[i]
                    step = d + cost + height[node] - height[to]
                    if left > 0 and step < far.get(to, float("inf")):
                        far[to], via[to] = step, i
                        heapq.heappush(heap, (step, number[to], to))
            if sink not in far:
                return
            top = max(far.values())
            for node in height:
                height[node] += far.get(node, top)
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.arcs[via[node] ^ 1][0]
            amount = min(self.arcs[i][1] for i in path)
            for i in path:
                self.arcs[i][1] -= amount
                self.arcs[i ^ 1][1] += amount


def quotas(total: int, shares: dict[str, int]) -> dict[str, int]:
    """Whole numbers that add up to total, in proportion to shares (largest remainders, then by name)."""
    whole = sum(shares.values()) or 1
    exact = {s: (total * x) / whole for s, x in shares.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(shares, key=lambda s: (out[s] - exact[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return out


Profile = tuple[tuple[str, int], ...]


def allocate(bundles: list[tuple[Profile, int]], shares: dict[str, int]) -> dict[Profile, dict[str, int]]:
    """How many groups of each bundle go to each split. bundles: (profile, groups), all groups of a bundle have the
    same number of clips of each label, which is the profile.

    The flow runs in rows from bundles to splits: a bundle's quota in a split costs nothing, rows beyond it
    LABEL_COST each, rows beyond the split's own quota SPLIT_COST each. Rounding gives whole groups, the largest
    first; of each bundle the groups that are left over go one by one to the split that lacks most of their labels, as
    far as it lacks that many rows at all.
    """
    splits = sorted(shares)
    size = {profile: sum(n for _, n in profile) for profile, _ in bundles}
    rows = {profile: size[profile] * n for profile, n in bundles}
    total = quotas(sum(rows.values()), shares)
    per_label: dict[str, int] = {}
    for profile, n in bundles:
        for label, k in profile:
            per_label[label] = per_label.get(label, 0) + k * n
    lack = {label: quotas(n, shares) for label, n in per_label.items()}
    flow, arcs = Flow(), {}
    for profile, n in sorted(rows.items()):
        flow.arc("s", ("p", profile), n, 0)
        own = quotas(n, shares)
        for s in splits:
            arcs[profile, s] = (flow.arc(("p", profile), ("q", s), own[s], 0), own[s]), (flow.arc(("p", profile), ("q", s), n, LABEL_COST), n)
    for s in splits:
        flow.arc(("q", s), "t", total[s], 0)
        flow.arc(("q", s), "t", sum(rows.values()), SPLIT_COST)
    if rows:
        flow.send("s", "t")
    flows = {key: sum(capacity - flow.arcs[i][1] for i, capacity in both) for key, both in arcs.items()}
    out: dict = {}

    def give(profile: Profile, s: str, n: int) -> None:
        out[profile][s] += n
        total[s] -= n * size[profile]
        for label, k in profile:
            lack[label][s] -= k * n

    for profile, n in sorted(bundles, key=lambda b: (-size[b[0]], b[0])):
        out[profile] = dict.fromkeys(splits, 0)
        # whole shares first: a bundle of many equal groups needs few steps
        for s in splits:
            give(profile, s, min(n - sum(out[profile].values()), max(0, min(flows[profile, s], total[s])) // size[profile]))
        for _ in range(n - sum(out[profile].values())):
            fits = {s: total[s] >= size[profile] for s in splits}
            missing = {s: fits[s] * sum(min(k, max(0, lack[label][s])) for label, k in profile) for s in splits}
            give(profile, max(splits, key=lambda s: (fits[s], missing[s], total[s], s)), 1)  # noqa: B023
    return out


def assign(clips: DataFrame, targets: DataFrame, seed: str = "split") -> DataFrame:
    """(path, split): each distinct path's new split; sizes follow targets (split, share_pct), groups stay whole.

    Groups of equal numbers of clips of each label are a bundle (null labels are a label of their own). The flow runs
    on the driver over at most MOST_BUNDLES bundles, the ones that hold most rows; groups of rarer mixtures are bundled
    by size and most frequent label, and there are fewer such bundles than labels times distinct sizes. Members of a
    bundle are dealt to splits in the order of a hash of their group. Empty tables give no rows; a target table without
    positive shares is refused.
    """
    shares = {}
    for r in targets.select(split_key(F.col("split")).alias("s"), "share_pct").collect():
        if r["s"] and r["share_pct"]:
            shares[r["s"]] = shares.get(r["s"], 0) + int(r["share_pct"])
    if not shares or min(shares.values()) < 0:
        raise ValueError("targets: no positive share")
    tied = cut(tied_clips(clips))
    labels = clips.where("path is not null").groupBy("path").agg(F.min(F.coalesce(label_key(F.col("label")), F.lit(""))).alias("l"))
    per_label = tied.join(labels, "path").groupBy("comp", "l").agg(F.count("*").alias("n"))
    counts = F.sort_array(F.collect_list(F.struct("l", "n")))
    top = F.array(F.struct(F.min(F.struct(-F.col("n"), F.col("l")))["l"].alias("l"), F.sum("n").alias("n")))
    groups = cut(per_label.groupBy("comp").agg(F.to_json(counts).alias("mixture"), F.to_json(top).alias("plain"), F.sum("n").alias("rows")))
    frequent = cut(groups.groupBy("mixture").agg(F.sum("rows").alias("r")).orderBy(F.col("r").desc(), "mixture").limit(MOST_BUNDLES).select("mixture"))
    groups = cut(groups.join(frequent.withColumn("held", F.lit(True)), "mixture", "left").select("comp", F.when(F.col("held"), F.col("mixture")).otherwise(F.col("plain")).alias("profile")))
    read = lambda text: tuple((x["l"], x["n"]) for x in json.loads(text))
    bundles = {r["profile"]: r["n"] for r in groups.groupBy("profile").agg(F.count("*").alias("n")).collect()}
    merged: dict[Profile, int] = {}
    for text, n in bundles.items():
        merged[read(text)] = merged.get(read(text), 0) + n
    given = allocate(sorted(merged.items()), shares)
    ranges, before = [], 0
    for text, n in sorted(bundles.items()):  # one text per profile
        for s, k in sorted(given[read(text)].items()):
            if k:
                ranges.append((text, before, before + k, s))
                before += k
    ranked = global_rank(groups, [F.col("profile"), F.md5(F.concat_ws(":", F.lit(seed), "comp")), F.col("comp")], "r")
    # the ranks of a bundle are consecutive, and so are its ranges
    part = clips.sparkSession.createDataFrame(ranges, "profile string, lo bigint, hi bigint, split string")
    split_of = ranked.join(F.broadcast(part), "profile").where("r >= lo and r < hi").select("comp", "split")
    return join_unique(tied, split_of, "comp", "inner").select("path", "split")


def balance(clips: DataFrame, targets: DataFrame) -> DataFrame:
    """One row that says how assign() did: paths, torn (groups in more than one split), worst_split_gap (the greatest
    part of all rows by which a split misses its share), worst_label_gap (the same for labels within splits) and
    largest (the part of all rows in the largest group, which no assignment can divide)."""
    new = cut(assign(clips, targets))
    labels = clips.where("path is not null").groupBy("path").agg(F.min(F.coalesce(label_key(F.col("label")), F.lit(""))).alias("l"))
    torn = tied_clips(clips).join(new, "path").groupBy("comp").agg(F.min("split").alias("a"), F.max("split").alias("b"), F.count("*").alias("n")).agg(F.count_if(F.col("a") != F.col("b")).alias("torn"), F.max("n").alias("largest"))
    share = targets.select(split_key(F.col("split")).alias("split"), "share_pct").groupBy("split").agg(F.sum("share_pct").alias("pct"))
    share = share.crossJoin(F.broadcast(share.agg(F.sum("pct").alias("whole")))).select("split", (F.col("pct") / F.col("whole")).alias("share"))  # three rows
    each = cut(new.join(labels, "path").groupBy("l", "split").agg(F.count("*").alias("n")))
    whole = each.agg(F.sum("n").alias("all"))
    per_label = each.groupBy("l").agg(F.sum("n").alias("of"))
    grid = per_label.crossJoin(F.broadcast(share))  # labels x splits
    label_gap = grid.join(each, ["l", "split"], "left").select(F.abs(F.coalesce("n", F.lit(0)) - F.col("of") * F.col("share")).alias("g")).agg(F.max("g").alias("label_gap"))
    split_gap = each.groupBy("split").agg(F.sum("n").alias("n")).join(F.broadcast(share), "split", "right").crossJoin(F.broadcast(whole)).select(F.abs(F.coalesce("n", F.lit(0)) - F.col("all") * F.col("share")).alias("g")).agg(F.max("g").alias("split_gap"))
    return whole.crossJoin(torn).crossJoin(split_gap).crossJoin(label_gap).select(F.coalesce("all", F.lit(0)).alias("paths"), "torn", F.col("split_gap") / F.col("all"), F.col("label_gap") / F.col("all"), F.col("largest") / F.col("all")).toDF("paths", "torn", "worst_split_gap", "worst_label_gap", "largest")  # one row each
