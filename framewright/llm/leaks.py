"""Problem 9: evaluation texts in the corpus, by winnowed word fingerprints that are joined and extended."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import cut

#: A leak is at least SPAN consecutive words. Grams of GRAM words in windows of SPAN - GRAM + 1 grams:
#: every shared span of SPAN words holds a window whose least gram is selected on both sides.
SPAN, GRAM = 13, 7
#: Characters of held-out texts that are sent to the workers at a time; more items take more passes.
BLOCK_CHARS = 8_000_000
#: Pairs of places of two texts that are extended one by one.
MANY_SEEDS = 10_000
#: Characters that are removed before words are cut.
INVISIBLE = dict.fromkeys([0x00AD, 0x200B, 0x200C, 0x200D, 0xFEFF])
_WORD = re.compile(r"[^\W_]+")
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits of the NFKC form without invisible characters, in lower case."""
    if not text:
        return []
    plain = text if text.isascii() else unicodedata.normalize("NFKC", text).translate(INVISIBLE)
    return _WORD.findall(plain.lower())


class WordHashes(dict):
    """64-bit numbers of words, the same in every process; frequent words are remembered."""

    MOST = 1 << 18

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_hashes = WordHashes()


def gram_hashes(h: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Polynomial hash of each run of `gram` word hashes, mixed, as unsigned 64-bit numbers."""
    if len(h) < gram:
        return np.array([], np.uint64)
    out = np.zeros(len(h) - gram + 1, np.uint64)
    for i in range(gram):
        out = out * _ODD + h[i : i + len(out)]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def winnow(texts: list[list[str]], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the selected grams: the last least hash of every window of span - gram + 1 grams.

    All texts are hashed in one array; windows across two texts are left out. A text of at least `span` words has
    at least one selected gram, shorter texts have none.
    """
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    flat = np.fromiter((_hashes[w] for t in texts for w in t), np.uint64, int(size.sum()))
    h, wide = gram_hashes(flat, gram), span - gram + 1
    if len(h) < wide:
        return np.array([], np.int64), np.array([], np.int64), np.array([], np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(h, wide)
    least = np.arange(len(windows)) + wide - 1 - windows[:, ::-1].argmin(axis=1)
    of = np.repeat(np.arange(len(texts)), size)[: len(windows)]
    inside = np.arange(len(windows)) + span <= (first + size)[of]
    chosen = np.zeros(len(h), bool)
    chosen[least[inside]] = True
    at = np.flatnonzero(chosen)
    text = np.searchsorted(first + size, at, "right")
    return text, at - first[text], h[at]


def longest_shared(a: list[str], b: list[str], seeds: list[tuple[int, int]]) -> int:
    """Length of the longest run of equal words through any of the seeds (place in a, place in b)."""
    best, done = 0, {}
    for i, j in sorted(seeds):
        if done.get(i - j, -1) >= i:
            continue
        lo = 0
        while i > lo and j > lo and a[i - lo - 1] == b[j - lo - 1]:
            lo += 1
        hi = 0
        while i + hi < len(a) and j + hi < len(b) and a[i + hi] == b[j + hi]:
            hi += 1
        done[i - j] = i + hi
        best = max(best, lo + hi)
    return best


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest run of words that both have, in linear time, by a suffix automaton of b."""
    follow: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for w in b:
        new = len(follow)
        follow.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and w not in follow[at]:
            follow[at][w] = new
            at = link[at]
        if at >= 0:
            to = follow[at][w]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                twin = len(follow)
                follow.append(dict(follow[to]))
                size.append(size[at] + 1)
                link.append(link[to])
                while at >= 0 and follow[at].get(w) == to:
                    follow[at][w] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    best = length = at = 0
    for w in a:
        while at and w not in follow[at]:
            at = link[at]
            length = size[at]
        if w in follow[at]:
            at = follow[at][w]
            length += 1
        best = max(best, length)
    return best


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, end): rows in order of keys, and where each run of equal keys begins and ends."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), bool)
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(change | (np.arange(len(order)) == 0))
    return order, first, np.append(first[1:], len(order))


class HeldOut:
    """Held-out texts, and the places of each of their fingerprints in ascending order of these."""

    def __init__(self, texts: list[str], span: int, gram: int):
        self.words = [words(t) for t in texts]
        text, place, fp = winnow(self.words, span, gram)
        order, first, end = _groups(fp, text)
        self.place, self.first, self.end = place[order], first, end
        self.fp, self.text = fp[order][first], text[order][first]

    def hits(self, texts: list[list[str]], span: int, gram: int) -> dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]]:
        """(text, held-out text) -> for each fingerprint that they share, its places in the one and in the other."""
        out: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        text, place, fp = winnow(texts, span, gram)
        order, first, end = _groups(text, fp)
        mine, own = fp[order][first], text[order][first]
        lo, hi = np.searchsorted(self.fp, mine, "left"), np.searchsorted(self.fp, mine, "right")
        for k in np.flatnonzero(hi > lo):
            for m in range(lo[k], hi[k]):
                out.setdefault((int(own[k]), int(self.text[m])), []).append((place[order[first[k] : end[k]]], self.place[self.first[m] : self.end[m]]))
        return out


def shared_run(a: list[str], b: list[str], hits: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """The longest run of words through any hit. Texts that repeat themselves have very many pairs of places; there the
    longest common run is the same, as every run of `span` words has a hit."""
    if sum(len(i) * len(j) for i, j in hits) > MANY_SEEDS:
        return longest_common(a, b)
    return longest_shared(a, b, [(int(x), int(y)) for i, j in hits for x in i for y in j])


def item_blocks(items: DataFrame) -> Iterator[pa.Table]:
    """(text, ids) of the distinct held-out texts, at most about BLOCK_CHARS characters at a time."""
    held = cut(items.where("item_id is not null and text is not null").groupBy("text").agg(F.collect_set("item_id").alias("ids")))
    total = held.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_CHARS))
    for b in range(blocks):
        yield held.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).toArrow()


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, item_id, words): documents that share a run of at least `span` words with an item.

    documents: doc_id, text; items: item_id, text; other columns are ignored. words is the length of the longest
    shared run. Null and short texts share nothing; copies count each under its own id; rows without an id are left
    out; of rows with one id each text counts. The held-out fingerprints and words go to the workers, a block at a
    time, and hits are extended where the text is read: no text of the corpus is moved.
    """
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    kinds = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, words int"
    parts = []
    for table in item_blocks(items):
        held, item_kind = HeldOut(table.column("text").to_pylist(), span, gram), table.schema.field("ids").type.value_type
        shared = documents.sparkSession.sparkContext.broadcast((held, table.column("ids").to_pylist()))

        def search(batches: Iterator[pa.RecordBatch], shared=shared, item_kind=item_kind) -> Iterator[pa.RecordBatch]:
            held, ids = shared.value
            for batch in batches:
                texts = [words(t) for t in batch.column("text").to_pylist()]
                rows, names, lengths = [], [], []
                for (i, m), hits in held.hits(texts, span, gram).items():
                    length = shared_run(texts[i], held.words[m], hits)
                    if length >= span:
                        rows += [i] * len(ids[m])
                        names += ids[m]
                        lengths += [length] * len(ids[m])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, item_kind), pa.array(lengths, pa.int32())], names=["doc_id", "item_id", "words"])

        parts.append(docs.mapInArrow(search, kinds))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every leak, each once."""
    return leaks(documents, items).select("doc_id", "item_id")
