"""A tree of centres that routes vectors to cells of similar ones, of about one size at any number of vectors.

Each node of the tree has at most FANOUT centres, fitted on a bounded sample of its own vectors. A child that would
hold far more vectors than wanted becomes a node itself in the next round, so a tree of two levels has up to
FANOUT * FANOUT cells, and a dense region gets more levels. A vector goes down to its most similar centre and to all
others within MARGIN of it. Centres that most of their vectors can't tell apart are one child.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

#: Centres of a node; vectors that they are fitted on, at most; vectors a centre.
FANOUT, SAMPLE, PER_CENTRE = 256, 16_384, 64
#: A vector enters all children within MARGIN of its best; centres are one child if most vectors of one are within
#: JOIN of the other.
MARGIN, JOIN = 0.01, 0.025
#: A child of more than GROWN times the wanted size is divided further.
GROWN = 8
#: Levels of a tree at most; what centres can't divide by then is divided like a structureless cell.
MOST_LEVELS = 4
#: Vectors in a task: structureless cells are divided into parts of this size, and their vectors search each part.
PART = 32_768
#: Cells of a tree, at most; with many more vectors the cells grow (a graph takes n log n). With the centres of inner
#: nodes a tree of 512 numbers is below 140 MB.
MOST_CELLS = FANOUT * FANOUT


def centres(vectors: np.ndarray, count: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Spherical k-means centres of unit vectors."""
    rng = np.random.default_rng(seed)
    out = vectors[rng.permutation(len(vectors))[:count]]
    for _ in range(rounds):
        own = (vectors @ out.T).argmax(axis=1)
        by = np.argsort(own, kind="stable")
        first = np.searchsorted(own[by], np.arange(len(out)))
        size = np.diff(np.append(first, len(own)))
        sums = np.zeros_like(out)
        sums[size > 0] = np.add.reduceat(vectors[by], first[size > 0], axis=0)
        sums[size == 0] = vectors[rng.integers(0, len(vectors), int((size == 0).sum()))]
        out = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
    return out.astype(np.float32)


def joined(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The group of each centre. k-means cuts a group of near-equal vectors at random, so that neighbours lie in any
    of its parts; such centres can't be told apart by their own vectors and are one group."""
    sims = unit @ centre.T
    own, best = sims.argmax(axis=1), sims.max(axis=1)
    root = list(range(len(centre)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(centre)):
        mine = own == i
        if mine.any():
            for j in np.flatnonzero((best[mine, None] - sims[mine] <= JOIN).mean(axis=0) > 0.5):
                a, b = top(i), top(int(j))
                root[max(a, b)] = min(a, b)
    return np.unique([top(i) for i in range(len(centre))], return_inverse=True)[1]


@dataclass
class Node:
    """centre: in the order of their child; first: where each child's centres begin; child: its node or ~cell."""

    centre: np.ndarray
    first: np.ndarray
    child: list[int]

    def entered(self, unit: np.ndarray) -> np.ndarray:
        """Whether each vector (rows) enters each child (columns)."""
        best = np.maximum.reduceat(unit @ self.centre.T, self.first, axis=1)
        return best >= best.max(axis=1, keepdims=True) - MARGIN


@dataclass
class Tree:
    """nodes[0] is the root; of each cell the expected vectors, and whether it is structureless."""

    nodes: list[Node] = field(default_factory=list)
    size: list[float] = field(default_factory=list)
    alike: list[bool] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    #: child that still has to be divided: (node, place of the child in it) -> expected vectors
    open: dict[int, tuple[int, int, float]] = field(default_factory=dict)

    def parts(self) -> np.ndarray:
        return np.array([max(1, -(-round(s) // PART)) if a else 1 for s, a in zip(self.size, self.alike, strict=True)])

    def _cell(self, size: float, alike: bool) -> int:
        self.size.append(size)
        self.alike.append(alike)
        return ~(len(self.size) - 1)

    def add(self, centre: np.ndarray, group: np.ndarray, share: np.ndarray, size: float, wanted: float, at: tuple[int, int] | None) -> None:
        """A node of `size` vectors, of which each group of centres has its share; at: the place that it takes."""
        by = np.argsort(group, kind="stable")
        node = Node(centre[by], np.searchsorted(group[by], np.arange(len(share))), [])
        number = len(self.nodes)
        self.nodes.append(node)
        self.depth.append(self.depth[at[0]] + 1 if at else 0)
        if at:
            self.nodes[at[0]].child[at[1]] = number
        for g, part in enumerate(share * size):
            many = int((group == g).sum()) > 1
            if part > (PART if many else GROWN * wanted) and len(share) > 1 and self.depth[number] < MOST_LEVELS - 1:
                self.open[len(self.open)] = (number, g, float(part))
                node.child.append(0)
            else:
                node.child.append(self._cell(float(part), many or part > PART))

    def route(self, unit: np.ndarray, only: bool = False) -> Iterator[tuple[np.ndarray, int]]:
        """(rows, cell) of each cell that vectors enter. only: (rows, number in open) of the children to be divided,
        each vector by its best child alone."""
        places = {(n, p): k for k, (n, p, _) in self.open.items()}
        todo = [(0, np.arange(len(unit)))]
        while todo:
            number, rows = todo.pop()
            if not len(rows):
                continue
            node = self.nodes[number]
            if only:
                best = np.maximum.reduceat(unit[rows] @ node.centre.T, node.first, axis=1).argmax(axis=1)
                goes = best[:, None] == np.arange(len(node.first))
            else:
                goes = node.entered(unit[rows])
            for p, child in enumerate(node.child):
                mine = rows[goes[:, p]]
                if not len(mine):
                    continue
                if only and (number, p) in places:
                    yield mine, places[number, p]
                elif child > 0:
                    todo.append((child, mine))
                elif not only:
                    yield mine, ~child


def fitted(unit: np.ndarray, size: float, wanted: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, their groups, share of the vectors in each group) of a node of about `size` vectors."""
    count = int(min(FANOUT, max(1, round(size / wanted)), max(1, len(unit) // 8)))
    centre = centres(unit, count)
    group = joined(unit, centre)
    own = group[(unit @ centre.T).argmax(axis=1)]
    return centre, group, np.bincount(own, minlength=group.max() + 1) / len(unit)
