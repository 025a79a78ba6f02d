"""Problem 8: ids of a byte-level BPE vocabulary for whole texts, by vectorised pre-tokenisation.

Words are cut as by the public pattern of this vocabulary: English contractions, runs of letters, digits or
other signs with one leading blank, and white space, of which the last blank goes to the word behind it.
No regular expression runs over the text: an array of codepoint classes is made once per block of texts, the
boundaries follow from comparisons of neighbouring classes, and the letters that a contraction takes are found
by a scan over transition functions. The slices between boundaries are encoded by cached pair merging.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import sys
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the vocabularies; a parameter of encode().
VOCABULARIES = "/opt/tokenizers"
BREAK, SPACE, LETTER, DIGIT, OTHER = range(5)
#: What may follow an apostrophe as a contraction of its own.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: The code points that count as white space.
WHITE_SPACE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Characters of a block of texts, and words that a worker remembers.
BLOCK_CHARS, CACHE_WORDS = 1 << 20, 1 << 18


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": DIGIT}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[[c for c in WHITE_SPACE if not 28 <= c <= 31]] = SPACE
    return table


def compose_scan(steps: np.ndarray, start: int) -> np.ndarray:
    """State after each place: steps[i][state] is the transition of place i. Function composition is
    associative, so the prefixes are built by doubling, in log2 of the length rounds."""
    upto, width = steps.copy(), 1
    while width < len(upto):
        upto[width:] = np.take_along_axis(upto[width:], upto[:-width], axis=1)
        width *= 2
    return upto[:, start]


def _contraction_letters(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How many letters each place takes as a contraction's apostrophe; 0 where it isn't one."""
    n = len(codes)
    before = np.append(BREAK, kind[:-1])
    code_before = np.append(0, codes[:-1])
    # an apostrophe opens a word if neither a blank nor other signs stand before it
    opens = np.flatnonzero((codes == 39) & (before != OTHER) & (code_before != 32))
    taken = np.zeros(n, np.uint8)
    for text in CONTRACTIONS:
        fits = opens[opens + len(text) < n]
        for i, letter in enumerate(text, 1):
            fits = fits[codes[fits + i] == ord(letter)]
        taken[fits] = len(text)
    return taken


def boundaries(codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places where a word begins, for texts that are laid out one after another with a BREAK behind each."""
    before, after = np.append(BREAK, kind[:-1]), np.append(kind[1:], BREAK)
    code_before = np.append(0, codes[:-1])
    starts = kind != before
    # a blank is taken along by the letters, digits or signs behind it
    led = starts & (kind >= LETTER) & (code_before == 32)
    starts &= ~led
    # the last of white space before a word stands alone or leads the word
    starts |= (kind == SPACE) & (after >= LETTER)
    taken = _contraction_letters(codes, kind)
    if taken.any():
        # state: letters that an apostrophe still takes; only the places near one are scanned
        near = np.unique((np.flatnonzero(taken)[:, None] + np.arange(4)).ravel())
        near = near[near < len(codes)]
        steps = np.repeat(np.array([[0, 0, 1]], np.uint8), len(near), axis=0)
        steps[np.append(True, np.diff(near) > 1)] = 0
        opening = taken[near] > 0
        steps[opening] = taken[near][opening][:, None]
        state = compose_scan(steps, 0)
        prior = np.append(0, state[:-1])
        prior[np.append(True, np.diff(near) > 1)] = 0
        inside = (prior > 0) & ~opening
        starts[near[inside]] = False
        # what follows a contraction begins a word
        ended = near[inside & (state == 0)] + 1
        starts[ended[kind[ended] >= LETTER]] = True
    starts[kind == BREAK] = False
    return np.flatnonzero(starts)


class Encoder:
    """Ids of words by repeatedly merging the pair of lowest rank; frequent words are remembered."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known = ranks, {}
        self.pieces = {i: b for b, i in ranks.items()}
        self.sizes = np.zeros(max(self.pieces, default=0) + 1, np.int64)
        self.sizes[list(self.pieces)] = [len(b) for b in self.pieces.values()]

    def word(self, word: str) -> list[int]:
        ids = self._merge(word.encode("utf-8", "replace"))
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        self.known[word] = ids
        return ids

    def _merge(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(raw) > 256:
            return self._merge_long(raw)
        parts, ranks, never = [raw[i : i + 1] for i in range(len(raw))], self.ranks, 1 << 60
        pairs = [ranks.get(parts[i] + parts[i + 1], never) for i in range(len(parts) - 1)]
        while pairs:
            least = min(pairs)
            if least == never:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], never)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
        return [ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """The same by a heap over a linked list: a long run of letters takes n log n steps."""
        ranks, n = self.ranks, len(raw)
        parts: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
                continue
            parts[i], parts[j], right[i] = pair, None, right[j]
            if right[j] < n:
                left[right[j]] = i
            for a in (left[i], i):
                b = right[a] if a >= 0 else n
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [ranks[p] for p in parts if p is not None]


@functools.cache
def encoder(path: str) -> Encoder:
    lines = Path(path).read_bytes().splitlines()
    return Encoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)})


def words(texts: list[str]) -> Iterator[list[str]]:
    """The words of each text, in order; joined they are the text."""
    held: list[str] = []
    chars = 0
    for i, text in enumerate(texts):
        held.append(text)
        chars += len(text)
        if chars >= BLOCK_CHARS or i == len(texts) - 1:
            yield from _block(held)
            held, chars = [], 0


def _block(texts: list[str]) -> Iterator[list[str]]:
    whole = "\0".join(texts) + "\0"
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[codes]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[ends] = BREAK
    at = boundaries(codes, kind)
    for first, end in zip(np.append(0, np.searchsorted(at, ends)[:-1]), ends, strict=True):
        own = at[first : np.searchsorted(at, end)].tolist()
        yield [whole[a:b] for a, b in itertools.pairwise([*own, int(end)])]


def encode(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, offsets: bool = True) -> DataFrame:
    """(doc_id, ids, offsets): ids of text without special tokens; null and empty texts give an empty list.

    offsets: the byte at which each id begins in the text's UTF-8 form, so that any stretch of ids leads back to its
    place; left out if offsets is false. Texts are taken as they are, whole, of any length; a text that spells out
    a special token is ordinary text. Every row has a result, repeated ones as well; doc_id passes through
    untouched, whatever its type, null included. A work file of the vocabulary, <vocabulary>.tiktoken, must lie in
    `folder` on every executor.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids: list[int] = []
            ends = [0]
            for pieces in words([t or "" for t in batch.column("text").to_pylist()]):
                known = enc.known
                for w in pieces:
                    ids.extend(known.get(w) or enc.word(w))
                ends.append(len(ids))
            flat, at = np.array(ids, np.int32), pa.array(ends, pa.int32())
            columns = [batch.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(flat))]
            if offsets:
                size = enc.sizes[flat]
                begin = np.cumsum(size) - size
                first = np.append(begin, 0)[np.minimum(ends[:-1], len(flat))]
                columns.append(pa.ListArray.from_arrays(at, pa.array(begin - np.repeat(first, np.diff(ends)))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", *(["offsets"] if offsets else [])])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>" + (", offsets array<bigint>" if offsets else ""))


def decode(encoded: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, text) of ids; a null list is an empty text, bytes that are no UTF-8 become U+FFFD."""
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces
        for batch in batches:
            texts = [b"".join([pieces[i] for i in ids or []]).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
