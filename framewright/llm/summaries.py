"""Deterministic rank-interval summaries of numbers: built per partition, compressed, merged in any order.

A summary of n values holds, in ascending order of v, tuples (v, lo, hi, under): the number of values up to v
lies in [lo, hi], and at most `under` values are smaller than v. The first tuple is the minimum, the last the
maximum, and the last hi is n. Every v is one of the summarised values. Merging adds the uncertainty of a
tuple's place in the other summary; compressing drops tuples as far as a permitted uncertainty allows. Errors are
shares of the rows. A summary made with error e leaves gaps of at most 2 e of its rows; merging adds up the gaps, so
they stay that share, and a tuple of the result can be off by one gap of the parts. So ranks are known to e where the
parts were made with e / 2.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
PARTS = ["v", "lo", "hi", "under"]
FIELDS = "v array<double>, lo array<bigint>, hi array<bigint>, under array<bigint>"
#: Rows that a task sorts at a time.
BLOCK = 400_000
#: Partitions whose summaries are merged together at the first of two levels.
FAN = 64


def exact(ordered: np.ndarray) -> Summary:
    """The summary of ascending values without any uncertainty; equal values are one tuple."""
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, len(ordered))
    return ordered[ends - 1], ends, ends, np.append(0, ends[:-1])


def size(s: Summary) -> int:
    return int(s[2][-1]) if len(s[0]) else 0


def _places(x: Summary, y: Summary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds for x's tuples that take the values of y into account."""
    left, right = np.searchsorted(y[0], x[0], "left"), np.searchsorted(y[0], x[0], "right")
    same = right > left
    lo = np.where(right > 0, y[1][np.maximum(right - 1, 0)], 0)
    beyond = np.where(right < len(y[0]), y[3][np.minimum(right, len(y[0]) - 1)], y[2][-1])
    at = np.minimum(left, len(y[0]) - 1)
    return x[1] + lo, x[2] + np.where(same, y[2][at], beyond), x[3] + np.where(same, y[3][at], beyond)


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of the values of both."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    v = np.concatenate([a[0], b[0]])
    bounds = [np.concatenate(x) for x in zip(_places(a, b), _places(b, a), strict=True)]
    v, first = np.unique(v, return_index=True)  # tuples of equal value have equal bounds by now
    lo, hi, under = (x[first] for x in bounds)
    return v, np.maximum.accumulate(lo), np.minimum.accumulate(hi[::-1])[::-1], np.minimum.accumulate(under[::-1])[::-1]


def gap(s: Summary) -> int:
    """The most values that may lie between two neighbouring tuples."""
    return int(np.maximum(s[3][1:] - s[1][:-1], 0).max()) if len(s[0]) > 1 else 0


def compress(s: Summary, permitted: float) -> Summary:
    """As few tuples as leave at most `permitted` values between two neighbours: the first, and then always the
    furthest one that is permitted. Neighbours that are further apart already stay."""
    if len(s[0]) < 3:
        return s
    # the furthest tuple that each may be followed by
    furthest = np.maximum(np.searchsorted(s[3], s[1] + int(permitted), "right") - 1, np.arange(1, len(s[0]) + 1))
    at, i, last = [0], 0, len(s[0]) - 1
    while i < last:
        i = min(int(furthest[i]), last)
        at.append(i)
    return tuple(x[at] for x in s)


def fold(parts: Iterable[Summary], error: float) -> Summary:
    """The summary of all parts, with ranks known to `error` of the rows if the parts were made with half of it.
    Parts are taken one by one; what is held is compressed whenever it has doubled, each time by the error that the
    rows so far permit, so neither the number of parts nor of compressions adds to the error."""
    held: Summary | None = None
    room = 0
    for part in parts:
        held = part if held is None else merge(held, part)
        if len(held[0]) > max(room, 4096):
            held = compress(held, 2 * error * size(held))
            room = 2 * len(held[0])
    return compress(held, 2 * error * size(held))


def bracket(s: Summary, rank: int) -> tuple[float, float]:
    """Two of the values between which the value of the given rank (from 1) lies for certain."""
    below = max(int(np.searchsorted(s[2], rank, "right")) - 1, 0)
    above = min(int(np.searchsorted(s[1], rank, "left")), len(s[0]) - 1)
    return float(s[0][below]), float(s[0][above])


def at_rank(s: Summary, rank: int) -> tuple[float, int]:
    """A value and how far the given rank can be from its ranks: they begin at under + 1 at most and end at lo at
    least."""
    off = np.maximum(np.maximum(s[3] + 1 - rank, rank - s[1]), 0)
    i = int(off.argmin())
    return float(s[0][i]), int(off[i])


def read(row) -> Summary:
    return (np.asarray(row.v, dtype=np.float64), *(np.asarray(getattr(row, k), dtype=np.int64) for k in PARTS[1:]))


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), FIELDS])


def summarize(df: DataFrame, keys: list[str], value: str, error: float) -> DataFrame:
    """keys and one summary per group and partition; a hot group has a small summary in every partition.

    keys are strings, null is a group as well. Null values take no part; value must not be NaN.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: dict[tuple, Summary] = {}

        def settle(block: pd.DataFrame) -> None:
            codes = block.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            values = block[value].to_numpy(np.float64)
            order = np.lexsort((values, codes))
            codes, values = codes[order], values[order]
            starts = np.append(0, np.flatnonzero(codes[1:] != codes[:-1]) + 1)
            names = block[keys].iloc[order[starts]].itertuples(index=False, name=None)
            for name, lo, hi in zip(names, starts, np.append(starts[1:], len(codes)), strict=True):
                key = tuple(None if pd.isna(x) else x for x in name)
                fresh = exact(values[lo:hi])
                done[key] = fold([done[key], fresh] if key in done else [fresh], error)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BLOCK:
                settle(pd.concat(held, ignore_index=True))
                held, rows = [], 0
        if rows:
            settle(pd.concat(held, ignore_index=True))
        items = list(done.items())
        for at in range(0, len(items), 512):
            yield pd.DataFrame([[*key, *s] for key, s in items[at : at + 512]], columns=[*keys, *PARTS])

    return df.select(*keys, value).where(F.col(value).isNotNull()).mapInPandas(part, _schema(df, keys))


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator[Summary]]]:
    """Rows in order of keys, by group; the summaries of a group are handed out one at a time."""

    def rows() -> Iterator[tuple[tuple, Summary]]:
        for batch in batches:
            names = list(zip(*(batch[k] for k in keys), strict=True))
            for name, row in zip(names, batch.itertuples(index=False), strict=True):
                yield tuple(None if pd.isna(x) else x for x in name), read(row)

    for key, group in itertools.groupby(rows(), key=lambda x: x[0]):
        yield key, (s for _, s in group)


def _in_runs(parts: DataFrame, keys: list[str], by: list[str], error: float) -> DataFrame:
    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for key, group in _runs(batches, by):
            rows.append([*key[: len(keys)], *fold(group, error)])
            if len(rows) == 512:
                yield pd.DataFrame(rows, columns=[*keys, *PARTS])
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=[*keys, *PARTS])

    return parts.repartition(*by).sortWithinPartitions(*by).mapInPandas(together, _schema(parts, keys))


def merge_groups(parts: DataFrame, keys: list[str], first: float, last: float) -> DataFrame:
    """One summary per group, merged in two levels: those of FAN neighbouring partitions first, then the rest.

    Summaries, not values, are shuffled, and a task holds one summary besides the one it merges into it. first and
    last: the errors that the two levels may use; each is above that of the level before.
    """
    salted = parts.withColumn("_salt", F.expr(f"cast(spark_partition_id() div {FAN} as string)"))
    return _in_runs(_in_runs(salted, keys, [*keys, "_salt"], first), keys, keys, last)


def merged(df: DataFrame, keys: list[str], value: str, error: float) -> DataFrame:
    """A summary per group with ranks known to `error` of its rows; partitions use a quarter of that, their first
    merge half of it."""
    return merge_groups(summarize(df, keys, value, error / 4), keys, error / 2, error)


def quantiles(summaries: DataFrame, keys: list[str], percents: list[float], error: float) -> DataFrame:
    """keys, percent, n, value, rank_error: value is one of the group's values, and one of its ranks is within
    rank_error of max(1, ceil(percent / 100 * n)). Groups without values have no rows. Summaries that don't know
    their ranks to `error` of the rows are refused (ValueError)."""
    kinds = dict(summaries.dtypes)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "percent", "n", "value", "rank_error"]
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                s = read(r)
                for p in percents:
                    rank = max(1, int(np.ceil(round(p * size(s) / 100, 9))))
                    value, off = at_rank(s, rank)
                    if off > error * size(s) + 1:
                        raise ValueError(f"a summary of {size(s)} values knows its ranks to {off} only")
                    rows.append([*(getattr(r, k) for k in keys), float(p), size(s), value, off])
            yield pd.DataFrame(rows, columns=names)

    return summaries.mapInPandas(answer, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "percent double, n bigint, value double, rank_error bigint"]))


def brackets(summaries: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """key, low, high: the value of rank `rank` lies in [low, high] for certain. wanted: key, rank."""
    kind = dict(summaries.dtypes)[key]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([[getattr(r, key), *bracket(read(r), r.rank)] for r in batch.itertuples(index=False)], columns=[key, "low", "high"])

    return summaries.join(wanted, key).mapInPandas(find, f"`{key}` {kind}, low double, high double")
