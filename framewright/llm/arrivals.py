"""Problem 4: duplicates of new batches against all history, by a stored segment index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.clean import hash64
from framewright.operators.dedup import first_wins
from framewright.operators.segments import SegmentIndex, close_hashes
from framewright.session import cut, new_folder

MAX_DISTANCE = 6
LAST_HISTORY_BATCH = 12


def clean_items(results: DataFrame) -> DataFrame:
    """Distinct (no, batch, is_duplicate, h) of the items with numbers and a hash."""
    items = results.select(F.col("item_no").cast("bigint").alias("no"), F.col("batch_no").cast("bigint").alias("batch"), "is_duplicate", hash64(F.col("hash_str")).alias("h"))
    return items.where("no is not null and batch is not null and h is not null").distinct()


def store_history(items: DataFrame, folder: str, last_history_batch: int = LAST_HISTORY_BATCH, max_distance: int = MAX_DISTANCE) -> SegmentIndex:
    """A new index in `folder` with the accepted items of the history, once; later batches only append. items: as of
    clean_items."""
    accepted = cut(items.where((F.col("batch") <= last_history_batch) & ~F.col("is_duplicate")).select("h", "no", "batch"))
    index = SegmentIndex.create(items.sparkSession, folder, max_distance, accepted.count())
    index.append(accepted)
    return index


def check_batch(index: SegmentIndex, items: DataFrame, batch: int) -> DataFrame:
    """no of the batch's items (h, no) that are close to an accepted item before them; what is accepted of the batch
    is appended to the index under the batch's number, so that a repeated batch replaces itself.

    Of the items of one hash only the first can be accepted, so the scan in order works on distinct hashes: the batch
    is probed against the index, and what is left is compared within the batch.
    """
    items = cut(items.select("h", "no").distinct())
    firsts = cut(items.groupBy("h").agg(F.min("no").alias("no")))
    known = cut(index.probe(firsts, before=batch).select("h").distinct())
    left = cut(firsts.join(known, "h", "left_anti"))
    near = close_hashes(left, left, index.settings["distance"], left.count()).where("a <> b")
    order = lambda h, no: left.select(F.col("h").alias(h), F.col("no").alias(no))
    edges = near.join(order("a", "early"), "a").join(order("b", "late"), "b").where("early < late").select("early", "late")
    rejected = first_wins(cut(edges)).select(F.col("ord").alias("no"))
    accepted = cut(left.join(rejected, "no", "left_anti"))
    index.append(accepted, batch)
    index.grow()
    return items.join(accepted.select("no"), "no", "left_anti").select("no")


def steps(items: DataFrame, last_history_batch: int) -> list[tuple[int, list[int]]]:
    """New batches in the order in which they are checked: (number to append under, batches). Batches whose item
    numbers overlap are one step, as items are checked in order of their numbers. One row a batch is collected."""
    ranges = items.where(F.col("batch") > last_history_batch).groupBy("batch").agg(F.min("no").alias("lo"), F.max("no").alias("hi")).collect()
    out: list[tuple[int, list[int]]] = []
    end = None
    for r in sorted(ranges, key=lambda r: (r["lo"], r["hi"])):
        if end is not None and r["lo"] <= end:
            out[-1][1].append(r["batch"])
            end = max(end, r["hi"])
        else:
            out.append((0, [r["batch"]]))
            end = r["hi"]
    # steps are numbered behind the history, so that `before` leaves out nothing that was appended earlier
    return [(last_history_batch + 1 + i, batches) for i, (_, batches) in enumerate(out)]


def found(results: DataFrame, last_history_batch: int = LAST_HISTORY_BATCH, max_distance: int = MAX_DISTANCE, folder: str | None = None) -> DataFrame:
    """item_no of the new batches' items that are close to an accepted item before them.

    results: item_no, batch_no, is_duplicate, hash_str; other columns are ignored. Accepted are the history's
    items with is_duplicate false and the new items that are not cases. Items without a hash are accepted and
    match nothing; rows without item_no or batch_no are left out; exact copies of rows count once. The history is
    stored once as a segment index (in `folder`, else in a new one below the shared folder), and then batch after
    batch is probed against it and appended.
    """
    items = cut(clean_items(results))
    index = store_history(items, folder or new_folder(items.sparkSession, "segments"), last_history_batch, max_distance)
    cases = items.select("no").limit(0)
    for number, batches in steps(items, last_history_batch):
        cases = cases.unionByName(cut(check_batch(index, items.where(F.col("batch").isin(batches)), number)))
    return cases.select(F.col("no").alias("item_no")).distinct()
