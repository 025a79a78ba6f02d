"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.llm import arrivals, bpe, cutoffs, leaks, neighbours, overlap, percentiles, sampling, splits, truncation
from framewright.session import table as t

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: neighbours.found(t(s, d, "lance_index")),
        "p2_found": lambda s, d: overlap.found(t(s, d, "clip_meta")),
        "p2_coverage": lambda s, d: overlap.coverage(t(s, d, "clip_meta")),
        "p2_records": lambda s, d: overlap.record_coverage(t(s, d, "clip_meta")),
        "p3_found": lambda s, d: splits.torn_groups(t(s, d, "clip_meta")),
        "p3_splits": lambda s, d: splits.assign(t(s, d, "clip_meta"), t(s, d, "split_target")),
        "p3_balance": lambda s, d: splits.balance(t(s, d, "clip_meta"), t(s, d, "split_target")).selectExpr("paths", "torn", "worst_split_gap <= 0.01 as splits_hold", "worst_label_gap <= 0.01 + largest as labels_hold"),
        "p4_found": lambda s, d: arrivals.found(t(s, d, "dedup_result")),
        "p5_found": lambda s, d: sampling.short_targets(t(s, d, "clip_meta"), t(s, d, "mixture_target")),
        "p5_sample": lambda s, d: sampling.sample(t(s, d, "clip_meta"), t(s, d, "mixture_target")),
        "p5_fulfilment": lambda s, d: sampling.fulfilment(t(s, d, "clip_meta"), t(s, d, "mixture_target")),
        "p6_found": lambda s, d: cutoffs.found(t(s, d, "clip_meta"), t(s, d, "keep_target")),
        "p6_cutoffs": lambda s, d: cutoffs.cutoffs(t(s, d, "clip_meta"), t(s, d, "keep_target")),
        "p7_percentiles": lambda s, d: percentiles.percentiles(percentiles.daily_summaries(t(s, d, "clip_meta"))),
        "p7_within": lambda s, d: percentiles.within_error(t(s, d, "clip_meta")),
        "p8_ids": lambda s, d: bpe.encode(t(s, d, "documents"), offsets=False),
        "p8_offsets": lambda s, d: bpe.encode(t(s, d, "documents")).select("doc_id", "offsets"),
        "p9_found": lambda s, d: leaks.found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p10_found": lambda s, d: truncation.found(t(s, d, "documents")),
        "p10_shares": lambda s, d: truncation.shares(t(s, d, "documents")),
    }
