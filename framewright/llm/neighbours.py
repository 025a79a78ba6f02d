"""Problem 1: the most similar vectors of every vector, by pruned graphs over shards of similar vectors."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.cells import FANOUT, MOST_CELLS, PER_CENTRE, SAMPLE, Tree, fitted
from framewright.llm.graph import Graph
from framewright.operators.distribute import join_unique
from framewright.session import cut

WIDTH, K, LEAST = 512, 5, 0.65
#: Vectors that a cell aims at.
SHARD = 2000
#: Edges of a point, and beams of the build and of the search. In cells without structure many vectors are almost
#: equally similar: there all three grow with the logarithm of the size, from 4 * WIDEN_FROM vectors.
PLAIN, WIDEN_FROM = (16, 16, 12), 1000
#: What float32 products may differ by from double ones, above half a unit of the sixth decimal.
NEAR_TIE = 3e-6
#: Vectors that a graph holds at most; a shard with more has several graphs, and each of its vectors searches them all.
HELD = 16_384
#: Rows that a task looks at together, and numbers of contents that it remembers, whatever its input holds; rows that
#: search a graph together.
ROWS, SEEN, ASKED = 2048, 65_536, 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), width)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("ij,ij->i", m, m, dtype=np.float64)).astype(np.float32)[:, None]


def _sliced(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def _packed(m: np.ndarray) -> pa.Array:
    """Each row compressed; bytes of equal weight side by side compress well."""
    codec = pa.Codec("zstd", compression_level=1)
    planes = np.ascontiguousarray(m.view(np.uint8).reshape(*m.shape, 4).transpose(0, 2, 1))
    return pa.array([codec.compress(x, asbytes=True) for x in planes], pa.binary())


def _unpacked(column: pa.Array, out: np.ndarray) -> np.ndarray:
    """The rows written to out, a block at a time, as larger buffers would stay with the process."""
    codec, width = pa.Codec("zstd"), out.shape[1]
    for lo in range(0, len(column), 512):
        some = column.slice(lo, 512)
        planes = np.empty((len(some), 4, width), np.uint8)
        for i, x in enumerate(some):
            planes[i] = np.frombuffer(codec.decompress(x.as_buffer(), width * 4), np.uint8).reshape(4, width)
        out[lo : lo + 512].view(np.uint8).reshape(len(some), width, 4)[:] = planes.transpose(0, 2, 1)
    return out


def _usable(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    """Paths, vectors and content numbers of the rows with a path and `width` finite numbers, not all zero."""
    vectors = batch.column("vector")
    fits = pc.and_(pc.is_valid(batch.column("path")), pc.equal(pc.list_value_length(vectors), width))
    rows = pa.array(np.flatnonzero(fits.fill_null(False).to_numpy(zero_copy_only=False)))
    paths, m = batch.column("path").take(rows), _matrix(vectors.take(rows), width) + np.float32(0)
    good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
    paths, m = paths.filter(pa.array(good)), np.ascontiguousarray(m[good])
    return paths, m, [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in m]


def content_numbers(index: DataFrame, width: int = WIDTH) -> DataFrame:
    """(path, gid): one row per path with a usable vector; equal vectors have equal gids. No vector is moved."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, ROWS):
            paths, _, gids = _usable(batch, width)
            yield pa.RecordBatch.from_arrays([paths, pa.array(gids, pa.binary())], names=["path", "gid"])

    return index.select("path", "vector").mapInArrow(number, "path string, gid binary").groupBy("path").agg(F.min("gid").alias("gid"))


def _hash_below(share: float):
    """Rows of about that share, by a hash of their path; the others are not handed to Python."""
    return F.xxhash64(F.lit("cells"), "path").bitwiseAND((1 << 32) - 1) < int(min(1.0, share) * (1 << 32))


def fit_cells(index: DataFrame, n: int, shard: int = SHARD, sample: int = SAMPLE, width: int = WIDTH) -> Tree:
    """The tree of cells of about n vectors. Each node is fitted on about `sample` of its own vectors at most, the
    root on the driver, the others in one task each; every round reads the index once."""
    wanted = max(shard, n / MOST_CELLS)
    ask = min(sample, max(4096, PER_CENTRE * min(FANOUT, round(n / wanted))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in _sliced(batches, ROWS):
            _, m, gids = _usable(batch, width)
            keep = [i for i, g in enumerate(gids) if g not in seen and not seen.add(g)]
            yield pa.RecordBatch.from_arrays([pa.array([gids[i] for i in keep], pa.binary()), pa.array([m[i].tobytes() for i in keep], pa.binary())], names=["gid", "raw"])

    def stacked(rows: pa.Table) -> np.ndarray:
        at = {g: i for i, g in enumerate(rows.column("gid").to_pylist())}
        m, raw = np.empty((len(at), width), np.float32), rows.column("raw")
        for i, g in enumerate(sorted(at)):
            m[i] = np.frombuffer(raw[at[g]].as_buffer(), np.float32)
        return _unit(m) if at else np.zeros((1, width), np.float32)

    tree = Tree()
    first = index.where(_hash_below(ask / max(n, 1))).select("path", "vector").mapInArrow(pick, "gid binary, raw binary").toArrow()
    unit = stacked(first)
    tree.add(*fitted(unit, n, wanted), n, wanted, None)
    spark = index.sparkSession.sparkContext
    while tree.open:
        shared = spark.broadcast((tree, {k: size for k, (_, _, size) in tree.open.items()}))
        most = max(1.0, min(size for _, _, size in tree.open.values()))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, sizes = shared.value
            for batch in _sliced(batches, ROWS):
                _, m, gids = _usable(batch, width)
                nodes, rows = [], []
                for mine, k in tree.route(_unit(m), only=True):
                    # the same share of every vector's copies, at most about `sample` vectors a node
                    limit = int(min(1.0, sample / sizes[k]) * (1 << 32))
                    for i in mine:
                        if int.from_bytes(gids[i][:4], "big") < limit:
                            nodes.append(k)
                            rows.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array([gids[i] for i in rows], pa.binary()), pa.array([m[i].tobytes() for i in rows], pa.binary())], names=["node", "gid", "raw"])

        def divide(rows: pa.Table) -> pa.Table:
            k = rows.column("node")[0].as_py()
            centre, group, share = fitted(stacked(rows), shared.value[1][k], wanted)
            return pa.table({"node": [k], "centre": [centre.tobytes()], "groups": [group.tolist()], "share": [share.tolist()]}, schema=pa.schema([("node", pa.int32()), ("centre", pa.binary()), ("groups", pa.list_(pa.int64())), ("share", pa.list_(pa.float64()))]))

        dealt = index.where(_hash_below(sample / most)).select("path", "vector").mapInArrow(deal, "node int, gid binary, raw binary").dropDuplicates(["node", "gid"])
        answers = dealt.groupBy("node").applyInArrow(divide, "node int, centre binary, groups array<bigint>, share array<double>").collect()
        done, tree.open = tree.open, {}
        got = {r["node"]: r for r in answers}
        for k, (number, place, size) in sorted(done.items()):
            if k in got:
                centre = np.frombuffer(bytes(got[k]["centre"]), np.float32).reshape(-1, width)
                tree.add(centre, np.array(got[k]["groups"]), np.array(got[k]["share"]), size, wanted, (number, place))
            else:
                tree.nodes[number].child[place] = tree._cell(size, False)
        shared.destroy()
    return tree


def _best(a: np.ndarray, b: np.ndarray, sims: np.ndarray, k: int, slack: float) -> np.ndarray:
    """Which of the pairs (a, b) reach the k-th greatest similarity of their a, less slack; ties are all kept."""
    order = np.lexsort((-sims, a))
    first = np.flatnonzero(np.append(True, np.diff(a[order]) > 0)[: len(a)])
    count = np.diff(np.append(first, len(a)))
    level = np.full(int(a.max()) + 1 if len(a) else 0, -np.inf)
    many = count >= k
    level[a[order[first[many]]]] = sims[order[first[many] + k - 1]]
    return sims >= level[a] - slack


def _both(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([a, b]), np.concatenate([b, a])


class Part:
    """The graph of some vectors of a shard (rows of raw), and for each the k greatest similarities found so far."""

    def __init__(self, raw: np.ndarray, alike: bool, k: int, least: float):
        self.raw, self.k, self.least, self.top = raw, k, least, np.full((len(raw), k), -np.inf)
        widen = max(1.0, np.log2(max(len(raw), 1) / WIDEN_FROM) / 2) if alike else 1.0
        degree, beam, self.beam = (round(x * widen) for x in PLAIN)
        self.graph = Graph(_unit(raw), degree, beam)

    def _found(self, unit: np.ndarray, points: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, point, similarity) of each row's beam; points: the rows are the points themselves."""
        asked, found = np.arange(len(unit)), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        wide = max(self.beam, self.k + 2)
        while len(asked):
            ids, s = self.graph.search(unit if len(asked) == len(unit) else unit[asked], wide, asked if points else None)
            # a beam that ends within a tie is widened
            more = (s[:, -1] >= s[:, min(self.k, s.shape[1] - 1)] - 2 * NEAR_TIE) & (s[:, -1] >= self.least - NEAR_TIE) & (ids.shape[1] < len(self.raw))
            rows, at = np.nonzero((ids >= 0) & (s >= self.least - NEAR_TIE) & ~more[:, None])
            found.append((asked[rows], ids[rows, at], s[rows, at]))
            asked, wide = asked[more], 2 * wide
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _exact(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rounded cosines in double precision of rows of raw and points."""
        out = np.empty(len(a))
        for lo in range(0, len(a), 1024):
            x, y = raw[a[lo : lo + 1024]].astype(np.float64), self.raw[b[lo : lo + 1024]].astype(np.float64)
            out[lo : lo + 1024] = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))
        return np.round(out, 6)

    def _keep(self, points: np.ndarray, exact: np.ndarray) -> None:
        order = np.lexsort((-exact, points))
        points, exact = points[order], exact[order]
        first = np.flatnonzero(np.append(True, np.diff(points) > 0)[: len(points)])
        place = np.arange(len(points)) - np.repeat(first, np.diff(np.append(first, len(points))))
        best = np.full((len(first), self.k), -np.inf)
        few = place < self.k
        best[np.searchsorted(points[first], points[few]), place[few]] = exact[few]
        own = points[first]
        self.top[own] = np.sort(np.concatenate([self.top[own], best], axis=1), axis=1)[:, -self.k :]

    def among(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, point, similarity): about the k most similar points of each, all of equal rounded similarity. What
        one of two found counts for the other as well."""
        a, b, s = self._found(self.graph.x, True)
        keep = a != b
        a, b, s = a[keep], b[keep], s[keep]
        _, once = np.unique(np.minimum(a, b) * len(self.raw) + np.maximum(a, b), return_index=True)
        a, b, s = a[once], b[once], s[once]
        keep = _best(*_both(a, b), np.concatenate([s, s]), self.k, 2 * NEAR_TIE).reshape(2, -1).any(axis=0)
        a, b = a[keep], b[keep]
        exact = np.tile(self._exact(self.raw, a, b), 2)
        a, b = _both(a, b)
        good = (exact >= self.least) & _best(a, b, exact, self.k, 0)
        a, b, exact = a[good], b[good], exact[good]
        self._keep(a, exact)
        return a, b, exact

    def asked(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, point, similarity, for whom) for other vectors: for 0 a row gets a point, for 1 the point gets the
        row, if it has fewer than k others so far that are more similar."""
        a, b, s = self._found(_unit(raw), False)
        row = _best(a, b, s, self.k, 2 * NEAR_TIE)
        keep = row | (s >= self.top[b, 0] - 2 * NEAR_TIE)
        a, b = a[keep], b[keep]
        exact = self._exact(raw, a, b)
        row, point = (exact >= self.least) & _best(a, b, exact, self.k, 0), (exact >= self.least) & (exact >= self.top[b, 0])
        self._keep(b[point], exact[point])
        whom = np.repeat([0, 1], [row.sum(), point.sum()])
        return np.concatenate([a[row], a[point]]), np.concatenate([b[row], b[point]]), np.concatenate([exact[row], exact[point]]), whom


def of_shard(raw: np.ndarray, own: np.ndarray, alike: bool, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity) of pairs of rows: for each about its k most similar among the rows that are `own`, all of
    equal rounded similarity; for those also other rows that found them."""
    points, others = np.flatnonzero(own), np.flatnonzero(~own)
    part = Part(raw[points], alike, k, least)
    a, b, sims = part.among()
    row, point, more, whom = part.asked(raw[others])
    row, point = others[row], points[point]
    return np.concatenate([points[a], np.where(whom, point, row)]), np.concatenate([points[b], np.where(whom, row, point)]), np.concatenate([sims, more])


def searched(batches: Iterable[pa.RecordBatch], alike: bool, k: int, least: float, width: int) -> Iterator[pa.RecordBatch]:
    """(gid, other, sim) of a shard; batches: own, gid, raw, each gid once, own rows first. A graph holds HELD vectors
    at most, whatever the shard holds: all others search it as they pass by. If more of them are own, they all wait
    in a file for the next graph."""
    named = lambda a, b, sims: pa.RecordBatch.from_arrays([a, b, pa.array(sims, pa.float64())], names=["gid", "other", "sim"])
    while batches is not None:
        raw, n, gids, rest, batches = np.empty((HELD, width), np.float32), 0, [], [], iter(batches)
        for batch in batches:
            mine = min(pc.sum(batch.column("own"), min_count=0).as_py(), HELD - n)
            _unpacked(batch.column("raw").slice(0, mine), raw[n : n + mine])
            gids.append(batch.column("gid").take(pa.array(np.arange(mine))))  # a slice would hold the whole batch
            n += mine
            if mine < len(batch):
                rest = [batch.slice(mine)]
                break
        batch = None
        if not n:
            return
        raw, own = raw[:n], pa.concat_arrays(gids)
        part = Part(raw, alike, k, least)
        a, b, sims = part.among()
        yield named(own.take(pa.array(a)), own.take(pa.array(b)), sims)
        file = tempfile.TemporaryFile() if rest and rest[0].column("own")[0].as_py() else None
        writer = file and pa.ipc.new_stream(file, rest[0].schema)
        for batch in _sliced(chain(rest, batches), ASKED):
            row, point, sims, whom = part.asked(_unpacked(batch.column("raw"), np.empty((len(batch), width), np.float32)))
            theirs, ours, own_first = batch.column("gid").take(pa.array(row)), own.take(pa.array(point)), pa.array(whom == 1)
            yield named(pc.if_else(own_first, ours, theirs), pc.if_else(own_first, theirs, ours), sims)
            if file:
                writer.write_batch(batch)
        batches = None
        if file:
            for lo in range(0, n, ROWS):
                some = raw[lo : lo + ROWS]
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(np.zeros(len(some), bool)), own.slice(lo, ROWS), _packed(some)], schema=rest[0].schema))
            writer.close()
            file.seek(0)
            batches = pa.ipc.open_stream(file)
        del part, raw


def neighbour_groups(index: DataFrame, tree: Tree, k: int = K, least: float = LEAST, width: int = WIDTH) -> DataFrame:
    """(gid, other, sim): for each distinct vector about the k most similar other ones, cosine rounded to 6.

    index: path, vector. Vectors are routed to their cells by the tree, each once per partition of the input however
    many copies there are; that is the only time vectors are moved. In every shard (a task each) a graph is built of
    its vectors and a beam search answers for each of them. A structureless cell beyond PART vectors is divided by
    content number into shards, and its vectors search each of these. A pair may come from more than one shard.
    """
    parts = tree.parts()
    first = np.cumsum([0, *parts])
    shared = index.sparkSession.sparkContext.broadcast((tree, parts, first))
    alike = np.repeat(np.array(tree.alike, bool), parts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tree, parts, first = shared.value
        for batch in _sliced(batches, ROWS):
            _, m, gids = _usable(batch, width)
            if len(seen) > SEEN:
                seen.clear()  # a copy may be sent again
            fresh = [i for i, g in enumerate(gids) if g not in seen and not seen.add(g)]
            if not fresh:
                continue
            m, gids = m[fresh], [gids[i] for i in fresh]
            home = np.array([int.from_bytes(g[8:12], "big") for g in gids])
            rows, shards, own = [], [], []
            for mine, cell in tree.route(_unit(m)):
                for part in range(parts[cell]):
                    rows.append(mine)
                    shards.append(np.full(len(mine), first[cell] + part))
                    own.append(home[mine] % parts[cell] == part)
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards), pa.int32()), pa.array(np.concatenate(own)), pa.array(gids, pa.binary()).take(at), _packed(m).take(at)], names=["shard", "own", "gid", "raw"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = (b for b in batches if len(b))
        head = next(filled, None)
        if head is None:
            return
        shard, arrived = head.column("shard")[0].as_py(), chain([head], filled)
        del head

        def once() -> Iterator[pa.RecordBatch]:
            last = None
            for batch in _sliced(arrived, ASKED):
                gids = batch.column("gid").to_pylist()
                keep = [i for i, g in enumerate(gids) if g != (gids[i - 1] if i else last)]
                last = gids[-1]
                batch = batch.select(["own", "gid", "raw"])
                yield batch if len(keep) == len(batch) else batch.take(pa.array(keep, pa.int64()))

        yield from searched(once(), bool(alike[shard]), k, least, width)

    work = index.select("path", "vector").mapInArrow(route, "shard int, own boolean, gid binary, raw binary")
    # a graph must not depend on the order of arrival; copies come in a row
    tasks = work.repartitionById(int(first[-1]), F.col("shard")).select("shard", "gid", "own", "raw").sortWithinPartitions(F.col("own").desc(), "gid")
    return tasks.mapInArrow(answer, "gid binary, other binary, sim double")


def neighbours(index: DataFrame, k: int = K, least: float = LEAST, shard: int = SHARD) -> DataFrame:
    """(path, other, sim, place): up to k most similar other paths of each path with a usable vector.

    index: path, vector; other columns are ignored. Similarity is the cosine in double precision rounded to 6
    decimals, at least `least`; among equals the smaller path goes first. Vectors that are null, all zero, of
    another length or not finite, and null paths, take no part; a path counts once (of several different vectors of
    one path, one is taken). Equal vectors enter the graph once; of their paths the k + 1 smallest are candidates,
    and every path of the group has its own result, so a vector that a third of the paths share costs no more than
    one. The graph is approximate: pairs can be missed (README: measured recall), and a pair may be reported in
    place of one that was missed.
    """
    rows = cut(content_numbers(index))
    by_path = Window.partitionBy("gid").orderBy("path")
    # row_number <= k + 1 is applied before the shuffle as well, so a hot group stays small
    heads = rows.select("gid", "path").withColumn("r", F.row_number().over(by_path)).where(F.col("r") <= k + 1)
    heads = heads.groupBy("gid").agg(F.sort_array(F.collect_list("path")).alias("heads"))
    near = neighbour_groups(index, fit_cells(index, index.count(), shard), k, least)
    itself = rows.select("gid", F.col("gid").alias("other"), F.lit(1.0).alias("sim")).distinct()
    ranked = near.unionByName(itself).join(heads.withColumnRenamed("gid", "other"), "other").select("gid", "sim", F.explode("heads").alias("other"))
    # in the place of its vector each pair once, the way the next steps need it
    ranked = ranked.repartition("gid").groupBy("gid", "other").agg(F.max("sim").alias("sim"))
    best = Window.partitionBy("gid").orderBy(F.col("sim").desc(), "other")
    lists = ranked.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).groupBy("gid").agg(
        F.sort_array(F.collect_list(F.struct("r", "other", "sim"))).alias("list")
    )
    each = join_unique(rows.select("path", "gid"), lists, "gid", "inner")
    own = F.slice(F.filter("list", lambda x: x["other"] != F.col("path")), 1, k)
    return each.select("path", F.posexplode(own).alias("p", "x")).select("path", "x.other", "x.sim", (F.col("p") + 1).alias("place"))


def found(index: DataFrame) -> DataFrame:
    """(path_a, path_b), path_a < path_b: either path is among the most similar of the other."""
    near = neighbours(index)
    return near.select(F.least("path", "other").alias("path_a"), F.greatest("path", "other").alias("path_b")).distinct()
