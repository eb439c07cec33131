"""Approximate nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts (spectral bisection, then swaps
that lower the cut), and a small classifier learns to tell from a vector in which parts its neighbours
lie. Parts grow with the table (some 32 times the root of its rows, MOST_PARTS at most). The index puts every
row into the COPIES parts that the classifier finds likeliest, by two levels: coarse branches of the
tree of cuts first, then the parts of the likeliest branches. Counts over all rows correct the classifier's
offsets, so parts are balanced on the whole table, not on the sample alone. A query goes to its most
probable parts, and what they hold is reranked by exact cosine in double precision.

How many parts a query needs is measured, not guessed: CALIBRATION queries that the fit hasn't seen are
searched exactly in all rows, and the least number of parts is taken that holds RECALL of their true
neighbours and two standard errors more.

Parts are packed into groups of BLOCK rows, in the order of the tree, so neighbouring parts meet
in one task; a part with more rows (a vector shared by a third of all) is dealt into blocks. A base row is
sent once for each of its parts, a query once for each group that it probes; a group's base is held (of a
vector that many rows share, the k + 1 smallest ids: no other can be among the k nearest) and its
queries stream by. A group sends a query's k nearest on, never all pairs.

The fit and its calibration read SAMPLE + CALIBRATION rows at most (the first by a hash of their id); every row is indexed.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
nor do those of another dimension than most of the sample; a query's own id is no candidate;
rows that share an id count once, with the nearest of their vectors (of a query id: the
smallest); ties go to the smaller id; queries whose parts hold fewer than k candidates are
searched in all parts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SAMPLE = 16_384
MOST_PARTS = 4096
ROWS_PER_PART = 8
COPIES = 2
BRANCHES = 64
NEAR_BRANCHES = 16
NEIGHBOURS = 10
#: Sets of the sample up to this size are cut by vectors instead of links.
SMALL_SET = 128
EPOCHS = 2
RECALL = 0.91
CALIBRATION = 256
BLOCK = 1 << 16
K = 5
#: Slack of the first pass, in single precision, over a group.
SLACK = 2e-5


def nearest(queries: np.ndarray, base: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Numbers of the k rows of base nearest to each unit query."""
    out = []
    for at in range(0, len(queries), 512):
        s = queries[at : at + 512] @ base.T
        if skip_self:
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out.append(np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k].astype(np.int32))  # a copy: a view would keep all of s
    return np.concatenate(out)


def bisect(graph: np.ndarray, nodes: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Which half each of `nodes` belongs to, for a neighbour graph (n, k) of all nodes."""
    number = np.full(len(graph), -1)
    number[nodes] = np.arange(len(nodes))
    a = np.repeat(np.arange(len(nodes)), graph.shape[1])
    b = number[graph[nodes]].ravel()
    a, b = a[b >= 0], b[b >= 0]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    n = len(nodes)
    degree = np.bincount(a, minlength=n) + 1e-9
    scale, root = 1 / np.sqrt(degree), np.sqrt(degree)
    root /= np.linalg.norm(root)
    x = random.normal(size=n)
    for _ in range(80 if n > 256 else 16):
        x -= root * (root @ x)
        x = 0.5 * x + 0.5 * scale * np.bincount(b, (scale * x)[a], n)
        x /= np.linalg.norm(x) + 1e-12
    half = np.zeros(n, np.int64)
    half[np.argsort(x * scale, kind="stable")[n // 2 :]] = 1
    for _ in range(20 if n > 256 else 4):  # swap the nodes that gain most on both sides
        other = np.bincount(a, half[b] != half[a], n)
        gain = 2 * other - np.bincount(a, minlength=n)
        left, right = (np.flatnonzero(half == s) for s in (0, 1))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        good = np.flatnonzero(gain[left[:m]] + gain[right[:m]] > 2)[: max(1, m // 20)]
        if not len(good):
            break
        half[left[good]], half[right[good]] = 1, 0
    return half


def small_halves(vectors: np.ndarray, sets: list[np.ndarray], random: np.random.Generator) -> np.ndarray:
    """bisect() for many sets of a few nodes each, which hardly hold a link of the graph: along the first principal axis of a set's vectors."""
    most = max(len(s) for s in sets)
    own = np.array([np.pad(s, (0, most - len(s)), constant_values=-1) for s in sets])
    there = (own >= 0)[..., None]
    x = np.where(there, vectors[own], 0)
    x = np.where(there, x - x.sum(1, keepdims=True) / there.sum(1, keepdims=True), 0)
    axis = random.normal(size=(len(sets), x.shape[2], 1)).astype(np.float32)
    for _ in range(8):
        axis = x.transpose(0, 2, 1) @ (x @ axis)
        axis /= np.linalg.norm(axis, axis=1, keepdims=True) + 1e-12
    rank = np.argsort(np.argsort(np.where(own >= 0, (x @ axis)[..., 0], np.inf), axis=1, kind="stable"), axis=1)
    half = np.zeros(len(vectors), np.int64)
    half[own[own >= 0]] = (rank >= there.sum(1) // 2)[own >= 0]
    return half


def balanced_parts(graph: np.ndarray, parts: int, vectors: np.ndarray | None = None) -> np.ndarray:
    """A part of each node: parts (a power of two) of equal size but for one node, numbered in the order of the tree of cuts."""
    label, random = np.zeros(len(graph), np.int64), np.random.default_rng(3)
    count = 1
    while count < parts:
        order = np.argsort(label, kind="stable")
        sets = np.split(order, np.searchsorted(label[order], np.arange(1, count)))
        if vectors is not None and len(sets[0]) <= SMALL_SET:
            half = small_halves(vectors, sets, random)
        else:
            half = np.zeros(len(graph), np.int64)
            for nodes in sets:
                half[nodes] = bisect(graph, nodes, random)
        label = 2 * label + half
        count *= 2
    return label


class Router:
    """A linear softmax over parts: logits of the parts that hold a vector's neighbours."""

    def __init__(self, weights: np.ndarray, branches: int = BRANCHES):
        self.weights, self.bias = weights, np.zeros(len(weights), np.float32)
        self.parts, self.dim = weights.shape
        self.branches = min(branches, self.parts)
        self.probes = self.parts
        self._shorten()

    def _shorten(self) -> None:
        """A branch's weights are the mean of its parts'."""
        self.coarse = self.weights.reshape(self.branches, -1, self.dim).mean(1)
        self.coarse /= np.linalg.norm(self.coarse, axis=1, keepdims=True) + 1e-12

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float32) @ self.weights.T + self.bias

    def fit(self, x: np.ndarray, near: np.ndarray, own: np.ndarray, rate: float = 0.05) -> None:
        """Softmax regression; near: the parts of each vector's neighbours, own: its part. Logits are sharpened as cosines lie close."""
        random, sharp = np.random.default_rng(4), 16.0
        for _ in range(EPOCHS):
            order = random.permutation(len(x))
            for at in range(0, len(x), 256):
                some = order[at : at + 256]
                z = sharp * (x[some] @ self.weights.T)
                z = np.exp(z - z.max(1, keepdims=True))
                z /= z.sum(1, keepdims=True)
                rows = np.arange(len(some))
                np.subtract.at(z, (np.repeat(rows, near.shape[1]), near[some].ravel()), np.float32(0.5 / near.shape[1]))
                z[rows, own[some]] -= np.float32(0.5)
                self.weights -= rate * (z.T @ x[some])
            self.weights /= np.linalg.norm(self.weights, axis=1, keepdims=True) + 1e-12
        self._shorten()

    def order(self, x: np.ndarray) -> np.ndarray:
        """All parts of each vector, the likeliest first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")

    def places(self, x: np.ndarray) -> np.ndarray:
        """The COPIES likeliest parts of each vector, among those of its NEAR_BRANCHES likeliest branches."""
        keep, x = min(COPIES, self.parts), x.astype(np.float32)
        n, own = min(NEAR_BRANCHES, self.branches), self.parts // self.branches
        best, score = np.zeros((len(x), keep), np.int64), np.full((len(x), keep), -np.inf, np.float32)
        rough = x @ self.coarse.T
        near = np.argpartition(-rough, n - 1, axis=1)[:, :n] if n < self.branches else np.tile(np.arange(self.branches), (len(x), 1))
        asked = np.zeros(rough.shape, bool)
        np.put_along_axis(asked, near, True, axis=1)
        for branch in range(self.branches):
            rows = np.flatnonzero(asked[:, branch])
            if not len(rows):
                continue
            first = branch * own
            z = x[rows] @ self.weights[first : first + own].T + self.bias[first : first + own]
            every = np.hstack([score[rows], z])
            parts = np.hstack([best[rows], np.broadcast_to(np.arange(first, first + own), z.shape)])
            top = np.argsort(-every, axis=1, kind="stable")[:, :keep]
            score[rows], best[rows] = np.take_along_axis(every, top, 1), np.take_along_axis(parts, top, 1)
        return best

    def balance(self, counts: np.ndarray, step: float = 0.01) -> None:
        """Lower the offsets of parts with more rows than others, raise those with fewer, by a bounded step."""
        share = counts / max(1.0, counts.mean())
        self.bias -= (step * np.clip(np.log(share + 0.1), -2, 2)).astype(np.float32)


def parts_for(rows: int) -> int:
    """A power of two: some 32 times the root of the rows, ROWS_PER_PART rows in each at least."""
    most = min(MOST_PARTS, 32 * rows**0.5, rows / ROWS_PER_PART, SAMPLE / 4)
    return 1 << max(0, int(most).bit_length() - 1)


def fit(sample: np.ndarray, parts: int) -> Router:
    """The router for unit vectors, one part if the sample is too small for more."""
    sample = sample.astype(np.float32)
    while parts > 1 and len(sample) < 4 * parts:
        parts //= 2
    if parts < 4:
        return Router(sample[:1])
    graph = nearest(sample, sample, NEIGHBOURS, True)
    label = balanced_parts(graph, parts, sample)
    weights = np.zeros((parts, sample.shape[1]), np.float32)
    np.add.at(weights, label, sample)
    weights /= np.linalg.norm(weights, axis=1, keepdims=True) + 1e-12
    router = Router(weights)
    router.fit(sample, label[graph], label)
    return router


def usable(vector: Column) -> Column:
    """Whether a vector takes part: all components finite, not all of them zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Arrays, or binary cells of their components, as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        cells = column.to_pylist()
        return np.frombuffer(b"".join(cells), f"<f{len(cells[0]) // dim}").reshape(-1, dim) if cells else np.zeros((0, dim), np.float32)
    return np.asarray(column.flatten()).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x)], pa.binary())


def best(q_ids: np.ndarray, ids: np.ndarray, number: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of the found pairs (query number, id, score) are among the query's k best: own id left out, an id once, ties to the smaller id."""
    keep = np.flatnonzero(ids != q_ids[number])
    keep = keep[np.lexsort((-score[keep], ids[keep], number[keep]))]
    new = np.ones(len(keep), bool)
    new[1:] = (number[keep][1:] != number[keep][:-1]) | (ids[keep][1:] != ids[keep][:-1])
    keep = keep[new]
    keep = keep[np.lexsort((ids[keep], -score[keep], number[keep]))]
    own = number[keep]
    return keep[np.arange(len(keep)) - np.searchsorted(own, own) < k]


class Base:
    """The rows of a group, by part. Of rows with one vector, those with the k + 1 smallest ids."""

    def __init__(self, ids: np.ndarray, vec: np.ndarray, part: np.ndarray, k: int):
        order = np.lexsort((ids, part))
        ids, vec, part = ids[order], np.ascontiguousarray(vec[order]), part[order]
        _, same = np.unique(np.hstack([vec.view(np.uint8).reshape(len(vec), -1), part[:, None].astype("<i4").view(np.uint8).reshape(len(vec), 4)]).view(f"V{vec.shape[1] * vec.itemsize + 4}").ravel(), return_inverse=True)
        by = np.argsort(same, kind="stable")  # ids ascend within equal vectors
        rank = np.arange(len(by)) - np.searchsorted(same[by], same[by])
        keep = np.sort(by[rank <= k])
        self.ids, self.vec, self.part = ids[keep], vec[keep].astype(np.float64), part[keep]
        self.unit = _unit(self.vec).astype(np.float32)
        self.norm = np.sqrt((self.vec * self.vec).sum(1))
        self.parts = np.unique(self.part)
        self.first = np.searchsorted(self.part, self.parts)
        self.end = np.searchsorted(self.part, self.parts, "right")
        #: how often an id stands in a part at most
        self.most = [int(np.unique(self.ids[a:b], return_counts=True)[1].max()) for a, b in zip(self.first, self.end)]

    def search(self, q_ids: np.ndarray, vec: np.ndarray, wanted: list[np.ndarray] | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, cosine, row) of each query's k nearest in the parts it wants (None: in all)."""
        vec = vec.astype(np.float64)
        unit, norm = _unit(vec).astype(np.float32), np.sqrt((vec * vec).sum(1))
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if wanted is not None:
            number = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted])
            flat = np.concatenate(wanted) if wanted else np.zeros(0, np.int64)
            order = np.argsort(flat, kind="stable")
            flat, number = flat[order], number[order]
        for part, a, b, most in zip(self.parts.tolist(), self.first.tolist(), self.end.tolist(), self.most):
            asks = np.arange(len(vec)) if wanted is None else number[np.searchsorted(flat, part) : np.searchsorted(flat, part, "right")]
            m = min(b - a, (k + 1) * most)
            for some in (asks[x : x + 256] for x in range(0, len(asks), 256)):
                rough = unit[some] @ self.unit[a:b].T
                least = np.partition(rough, b - a - m, axis=1)[:, b - a - m] - np.float32(SLACK)
                i, j = np.nonzero(rough >= least[:, None])
                pairs.append((some[i], j + a))
        number, row = (np.concatenate(x) for x in zip(*pairs))
        score = np.empty(len(row))
        for x in range(0, len(row), 1 << 16):
            n, r = number[x : x + (1 << 16)], row[x : x + (1 << 16)]
            score[x : x + (1 << 16)] = (self.vec[r] * vec[n]).sum(1) / (self.norm[r] * norm[n])
        keep = best(q_ids, self.ids[row], number, score, k)
        return number[keep], self.ids[row[keep]], score[keep], row[keep]


_FOUND = "query_id long, vec_id long, score double"


def _indexed(rows: DataFrame, router: Router) -> DataFrame:
    """id, vec (binary), part: a row for each of a vector's likeliest parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("vec"), router.dim)
                places = router.places(_unit(x))
                take = pa.array(np.repeat(np.arange(len(x)), places.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), _cells(x).take(take), pa.array(places.ravel().astype(np.int32))], ["id", "vec", "part"])

    return rows.select("id", "vec").mapInArrow(c.tidy(run), "id long, vec binary, part int")


def _counts(rows: DataFrame, router: Router) -> np.ndarray:
    """How many rows each part would have, over the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(router.parts, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(router.places(_unit(_matrix(batch.column("vec"), router.dim))).ravel(), minlength=router.parts)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["part", "n"])

    out = np.zeros(router.parts)
    for r in rows.select("vec").mapInArrow(c.tidy(run), "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():
        out[r["part"]] = r["n"]
    return out


def exact_neighbours(index: DataFrame, ids: np.ndarray, vec: np.ndarray, k: int) -> DataFrame:
    """query number, vec_id, score, part: the k nearest of all rows of the index for a few queries, and a row for each part they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            base = Base(batch.column("id").to_numpy(), _matrix(batch.column("vec"), vec.shape[1]), np.zeros(batch.num_rows, np.int64), 2 * k)
            number, found, score, _ = base.search(ids, vec, None, k)
            held = [np.concatenate([x, y]) for x, y in zip(held, (number, found, score, number))]
            keep = best(ids, held[1], held[0], held[2], k)
            held = [x[keep] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2])], ["number", "vec_id", "score"])

    found = index.select("id", "vec").mapInArrow(c.tidy(run), "number long, vec_id long, score double").distinct()
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("number", "vec_id", "score")


def calibrate(router: Router, index: DataFrame, ids: np.ndarray, vec: np.ndarray, k: int) -> float:
    """Set the router's probes by exact search of a few queries; the recall that they reach."""
    truth = exact_neighbours(index, ids, vec, k)
    # CALIBRATION * k neighbours, each with the parts of its copies
    rows = index.join(F.broadcast(truth.select(F.col("vec_id").alias("id"), "number")), "id").groupBy("number", "id").agg(F.collect_set("part").alias("parts")).collect()
    rank = np.argsort(router.order(_unit(vec)), axis=1)
    need = np.array([min(rank[r["number"], p] for p in r["parts"]) for r in rows]) if rows else np.zeros(1)
    wanted = min(1.0, RECALL + 2 * (RECALL * (1 - RECALL) / len(need)) ** 0.5)
    router.probes = int(np.sort(need)[max(0, int(np.ceil(wanted * len(need))) - 1)]) + 1
    return float((need < router.probes).mean())


def _plan(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of each part: parts follow each other in groups of BLOCK rows, a larger part has several of its own."""
    first, blocks = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    group, size = 0, 0
    for part, n in enumerate(counts.tolist()):
        if size and size + n > BLOCK:
            group, size = group + 1, 0
        first[part] = group
        if n > BLOCK:
            blocks[part] = -(-int(n) // BLOCK)
            group, size = group + int(blocks[part]), 0
        else:
            size += n
    return first, blocks


def _search(index: DataFrame, queries: DataFrame, router: Router, probes: int, counts: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k nearest within its parts."""
    first, blocks = _plan(counts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part").to_numpy()
                salt = (c.mix(batch.column("id").to_numpy().astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(first[part] + salt % blocks[part]), pa.array(np.zeros(n, np.int32)), batch.column("id"), batch.column("vec"), _cells(part.astype("<i4")[:, None])], ["key", "asks", "id", "vec", "parts"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = _matrix(batch.column("vec"), router.dim)
                likeliest = router.order(_unit(x))[:, :probes]
                keys, rows, cells = [], [], []
                for i, own in enumerate(likeliest):
                    own = np.sort(own[counts[own] > 0])
                    group = np.repeat(first[own], blocks[own]) + np.arange(int(blocks[own].sum())) - np.repeat(np.cumsum(blocks[own]) - blocks[own], blocks[own])
                    part = np.repeat(own, blocks[own]).astype("<i4")
                    heads = np.flatnonzero(np.diff(group, prepend=-1))
                    keys += group[heads].tolist()
                    rows += [i] * len(heads)
                    cells += [piece.tobytes() for piece in np.split(part, heads[1:])] if len(heads) else []
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.ones(len(keys), np.int32)), batch.column("id").take(take), _cells(x).take(take), pa.array(cells, pa.binary())], ["key", "asks", "id", "vec", "parts"])

    schema = "key long, asks int, id long, vec binary, parts binary"
    rows = index.mapInArrow(c.tidy(place), schema).unionByName(queries.select("id", "vec").mapInArrow(c.tidy(ask), schema))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, base = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            mark = batch.column("key").to_numpy() * 2 + batch.column("asks").to_numpy()
            cuts = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1).tolist(), len(mark)]
            for a, b in zip(cuts, cuts[1:]):
                own, piece = int(mark[a]) >> 1, batch.slice(a, b - a)
                if own != key:
                    key, held, base = own, [], None
                if not mark[a] & 1:
                    held.append(piece)
                    continue
                if held:
                    table = pa.Table.from_batches(held)
                    part = np.frombuffer(b"".join(table.column("parts").to_pylist()), "<i4").astype(np.int64)
                    base, held = Base(table.column("id").to_numpy(), _matrix(table.column("vec"), router.dim), part, k), []
                if base is None:
                    continue
                wanted = [np.frombuffer(x, "<i4").astype(np.int64) for x in piece.column("parts").to_pylist()]
                q_ids = piece.column("id").to_numpy()
                number, ids, score, _ = base.search(q_ids, _matrix(piece.column("vec"), router.dim), wanted, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[number]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return rows.repartition("key").sortWithinPartitions("key", "asks").mapInArrow(c.tidy(rank), _FOUND)


class Index:
    """Partitions of a table: the router, the rows by part in the shared folder, and how many each part has.

    insert() and remove() give a new index without a new fit; rebuild() fits anew; save() and load() keep it in a folder.
    """

    def __init__(self, router: Router, rows: DataFrame, counts: np.ndarray):
        self.router, self.rows, self.counts = router, rows, counts

    @classmethod
    def build(cls, rows: DataFrame, sample: int = SAMPLE, k: int = K) -> Index | None:
        """Of rows(id, vec) of usable vectors; None if there are none."""
        some = rows.orderBy(F.xxhash64("id"), "id", "vec").limit(sample + CALIBRATION).select("id", "vec").toArrow()
        if not some.num_rows:
            return None
        dims = Counter(len(x) for x in some.column("vec"))
        dim = max(dims, key=lambda n: (dims[n], n))
        some = some.filter(pa.array([len(x) == dim for x in some.column("vec")]))
        rows = rows.where(F.size("vec") == dim)
        x = _matrix(some.column("vec"), dim)
        held = min(CALIBRATION, len(x) // 8)
        router = fit(_unit(x[held:]), parts_for(rows.count()))
        if router.parts > 1:
            for _ in range(2):
                router.balance(_counts(rows, router))
        found = cls._of(router, rows)
        if router.parts > 1:
            calibrate(router, found.rows, some.column("id").to_numpy()[:held], x[:held], k)
        return found

    @classmethod
    def _of(cls, router: Router, rows: DataFrame) -> Index:
        written = c.materialize(_indexed(rows, router), "ann-index")
        counts = np.zeros(router.parts)
        for r in written.groupBy("part").count().collect():  # one row for each part
            counts[r["part"]] = r["count"]
        return cls(router, written, counts)

    def _with(self, rows: DataFrame) -> Index:
        counts = np.zeros(self.router.parts)
        for r in rows.groupBy("part").count().collect():
            counts[r["part"]] = r["count"]
        return Index(self.router, rows, counts)

    def insert(self, rows: DataFrame) -> Index:
        """With more rows(id, vec), by the same router."""
        more = c.materialize(_indexed(rows.where(F.size("vec") == self.router.dim), self.router), "ann-index")
        return self._with(self.rows.unionByName(more))

    def remove(self, ids: DataFrame) -> Index:
        """Without the rows whose id is in ids(id)."""
        return self._with(c.materialize(self.rows.join(ids.select("id").distinct(), "id", "left_anti").select("id", "vec", "part"), "ann-index"))

    def vectors(self) -> DataFrame:
        """id, vec (binary): each row once."""
        return self.rows.dropDuplicates(["id", "vec"]).select("id", "vec")

    def stats(self) -> dict[str, float]:
        """Parts, rows (with copies), the largest part and the share of rows that a query meets on average."""
        total = float(self.counts.sum())
        return {"parts": self.router.parts, "probes": self.router.probes, "rows": total, "largest_part": float(self.counts.max()), "mean_share": self.router.probes / self.router.parts}

    def save(self, folder: str) -> None:
        r = self.router
        self.rows.write.mode("overwrite").parquet(f"{folder}/rows")
        cells = [(r.weights.astype("<f4").tobytes(), r.bias.astype("<f4").tobytes(), self.counts.astype("<f8").tobytes(), r.dim, r.branches, r.probes)]
        self.rows.sparkSession.createDataFrame(cells, "weights binary, bias binary, counts binary, dim int, branches int, probes int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/router")

    @classmethod
    def load(cls, spark, folder: str) -> Index:
        c.prepare(spark)
        row = spark.read.parquet(f"{folder}/router").first()
        router = Router(np.frombuffer(row["weights"], "<f4").reshape(-1, row["dim"]).copy(), row["branches"])
        router.bias, router.probes = np.frombuffer(row["bias"], "<f4").copy(), row["probes"]
        return cls(router, spark.read.parquet(f"{folder}/rows"), np.frombuffer(row["counts"], "<f8").copy())

    def search(self, queries: DataFrame, k: int = K) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found for queries(id, vec), of which ids don't repeat."""
        queries = queries.where(F.size("vec") == self.router.dim)
        found = c.materialize(_search(self.rows, queries, self.router, self.router.probes, self.counts, k), "ann-found")
        if self.router.probes < self.router.parts:
            enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
            short = c.materialize(queries.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "ann-short")
            if not short.isEmpty():
                again = _search(self.rows, short, self.router, self.router.parts, self.counts, k)
                found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
        of_id = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return of_id.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable_rows(vectors: DataFrame) -> DataFrame:
    """id, vec (in their own precision) of vectors(vec_id, embedding) that take part."""
    kind = "array<double>" if "double" in dict(vectors.dtypes)["embedding"] else "array<float>"
    return vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("vec"))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = K, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of `vectors` that is a query."""
    spark = c.prepare(vectors.sparkSession)
    index = Index.build(usable_rows(vectors), sample, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = usable_rows(vectors.where(is_query)).where(F.size("vec") == index.router.dim).groupBy("id").agg(F.min("vec").alias("vec"))
    return index.search(c.materialize(queries, "ann-asked"), k)
