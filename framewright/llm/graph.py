"""A robust-pruned directed graph over unit vectors of one shard, in numpy, for many searches at a time.

Points enter in batches that double. A greedy beam search on the graph so far proposes neighbours; of these,
relaxed distance pruning keeps a diverse few: a candidate goes if a kept one is closer to it, by the factor
`slack`, than the point is. Every new edge is then offered to the point at its other end, and pruned alike.

Queries are searched in blocks of similar ones, and a block shares its frontier: in each step every beam names
its best points that are not expanded yet, their neighbours are looked up once, and one matrix product gives
the similarities of all queries of the block to all of them. Searches start at a sample of the points and, for
points of the graph, at the points themselves.
"""

from __future__ import annotations

import numpy as np

#: Queries that share a frontier, and points that a beam names in one step.
BLOCK, WIDE = 128, 4
#: Vectors that are compared with leaders at once; only their best leader is kept.
SLICE = 1024


def _take(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take_along_axis(a, at, axis=1)


class Graph:
    """vectors: float32 of unit length, one row per point. Deterministic for a seed."""

    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 16, slack: float = 1.15, seed: int = 0):
        self.x, self.degree, self.beam, self.slack = vectors, degree, beam, slack
        n = len(vectors)
        self.order = np.random.default_rng(seed).permutation(n)
        self.near = np.full((n, degree), -1, np.int64)
        self.sims = np.full((n, degree), -2, np.float32)
        self.entered = np.zeros(n + 1, bool)  # the last place stands for no point
        at = 0
        while at < n:
            self._insert(self.order[at : at + max(BLOCK, at)], at)
            at += max(BLOCK, at)

    def _blocks(self, vectors: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """Places in `rows` in blocks of similar vectors: those of one leader, leaders that are alike in a row."""
        if not len(rows):
            return []
        leaders = self.x[self.order[: max(1, min(len(self.x), len(rows)) // 64)]]
        own, most = np.empty(len(rows), np.int64), np.empty(len(rows), np.float32)
        for lo in range(0, len(rows), SLICE):
            sims = vectors[rows[lo : lo + SLICE]] @ leaders.T
            own[lo : lo + SLICE], most[lo : lo + SLICE] = sims.argmax(axis=1), sims.max(axis=1)
        place = np.argsort(np.argsort(leaders @ leaders[0], kind="stable"), kind="stable")
        by = np.lexsort((-most, place[own]))
        return np.array_split(by, max(1, round(len(by) / BLOCK)))

    def _search(self, queries: np.ndarray, beam: int, known: int, start: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The beams of one block among the first `known` points to enter, best first."""
        n = len(self.x)
        seen, expanded = ~self.entered, np.zeros(n + 1, bool)
        expanded[n] = True
        fresh = self.order[: min(known, max(8, known // 16))]
        if start is not None:
            fresh = np.union1d(fresh, start)
        ids, sims = np.full((len(queries), beam), n), np.full((len(queries), beam), -2, np.float32)
        while True:
            if len(fresh):
                seen[fresh] = True
                both = np.concatenate([sims, queries @ self.x[fresh].T], axis=1)
                best = np.argpartition(both, -beam, axis=1)[:, -beam:]
                sims = _take(both, best)
                ids = np.where(best < beam, _take(ids, np.minimum(best, beam - 1)), fresh[np.maximum(best - beam, 0)])
            named = ids
            if beam > WIDE:
                open_ = np.where(expanded[ids], np.float32(-3), sims)
                named = _take(ids, np.argpartition(open_, -WIDE, axis=1)[:, -WIDE:])
            named = np.unique(named[~expanded[named]])
            if not len(named):
                break
            expanded[named] = True
            reached = np.zeros(n + 1, bool)
            reached[self.near[named]] = True  # -1 is the last place
            fresh = np.flatnonzero(reached & ~seen)
        order = np.argsort(-sims, axis=1, kind="stable")
        return _take(np.where(ids == n, -1, ids), order), _take(sims, order)

    def search(self, queries: np.ndarray, beam: int, points: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The beam (ids, similarities; best first, -1 where there is none) of each query; points: the numbers of
        queries that are points of the graph."""
        beam = min(beam, max(1, len(self.x)))
        ids, sims = np.full((len(queries), beam), -1), np.full((len(queries), beam), -2, np.float32)
        for at in self._blocks(queries, np.arange(len(queries))) if len(self.x) else []:
            ids[at], sims[at] = self._search(queries[at], beam, len(self.x), None if points is None else points[at])
        return ids, sims

    def prune(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Up to `degree` diverse neighbours of each point among candidates in order of similarity."""
        m, width = ids.shape
        apart = np.maximum(2 - 2 * sims, 0)  # squared distances
        alive = (ids >= 0) & (ids != points[:, None])
        alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        out, kept, count = np.full((m, self.degree), -1, np.int64), np.full((m, self.degree), -2, np.float32), np.zeros(m, np.int64)
        cand = self.x[np.maximum(ids, 0)]
        between = self.slack * self.slack * np.maximum(2 - 2 * np.matmul(cand, cand.transpose(0, 2, 1)), 0)
        for i in range(width):
            rows = np.flatnonzero(alive[:, i] & (count < self.degree))
            if not len(rows):
                continue
            out[rows, count[rows]], kept[rows, count[rows]] = ids[rows, i], sims[rows, i]
            count[rows] += 1
            alive[rows, i + 1 :] &= between[rows, i, i + 1 :] > apart[rows, i + 1 :]
        return out, kept

    def _insert(self, batch: np.ndarray, known: int) -> None:
        for at in self._blocks(self.x, batch):
            # points of a block enter together: each sees the others besides what its search proposes
            x = self.x[batch[at]]
            sims = x @ x.T
            top = np.argsort(-sims, axis=1, kind="stable")[:, : self.beam + 1]
            ids, sims = batch[at][top], _take(sims, top)
            if known:
                more, their = self._search(x, self.beam, known, None)
                ids, sims = np.concatenate([ids, more], axis=1), np.concatenate([sims, their], axis=1)
                best = np.argsort(-sims, axis=1, kind="stable")[:, : self.beam + 1]
                ids, sims = _take(ids, best), _take(sims, best)
            self.near[batch[at]], self.sims[batch[at]] = self.prune(batch[at], ids, sims)
        self.entered[batch] = True
        self._reverse(batch)

    def _reverse(self, batch: np.ndarray) -> None:
        """Offer every edge of the batch to the point that it leads to, `degree` at a time, the most similar first."""
        to, source, sims = self.near[batch].ravel(), np.repeat(batch, self.degree), self.sims[batch].ravel()
        keep = to >= 0
        to, source, sims = to[keep], source[keep], sims[keep]
        order = np.lexsort((source, -sims, to))
        to, source, sims = to[order], source[order], sims[order]
        first = np.flatnonzero(np.append(True, to[1:] != to[:-1])[: len(to)])
        count = np.diff(np.append(first, len(to)))
        place = np.arange(self.degree)[None, :]
        while len(first):
            for lo in range(0, len(first), BLOCK):
                f, c = first[lo : lo + BLOCK], count[lo : lo + BLOCK]
                t, at, offered = to[f], np.minimum(f[:, None] + place, len(to) - 1), place < c[:, None]
                ids = np.concatenate([self.near[t], np.where(offered, source[at], -1)], axis=1)
                s = np.concatenate([self.sims[t], np.where(offered, sims[at], np.float32(-2))], axis=1)
                by = np.lexsort((ids, -s), axis=1)
                ids, s = _take(ids, by), _take(s, by)
                full = (ids >= 0).sum(axis=1) > self.degree
                self.near[t[~full]], self.sims[t[~full]] = ids[~full][:, : self.degree], s[~full][:, : self.degree]
                if full.any():
                    self.near[t[full]], self.sims[t[full]] = self.prune(t[full], ids[full], s[full])
            left = count > self.degree
            first, count = first[left] + self.degree, count[left] - self.degree

    def nearest(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams of points of the graph itself."""
        return self.search(self.x[points], beam, points)

    def query(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beams of any unit vectors."""
        return self.search(queries, beam)
