"""What is asked of all pairs of vectors, without the pairs: each vector's mean cosine and its k best partners.

Vectors are packed into blocks of bounded size. Blocks meet as rows of a Cartesian product, which reads them again
and shuffles nothing in the square of the table; a task keeps k partners, or one sum, of each of its vectors.
Cosines are rounded to six digits before they are compared or added. A vector of norm 0, or with components that
are null or not finite, and a pair of different lengths have cosine 0; a null vector has cosine null, which comes last.
Rows of equal id don't meet. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import drop, importable, store

#: Vectors and components of a block at most, blocks that a block meets in a task, tasks wanted.
BLOCK, CELLS, MEETS, TASKS = 4096, 1 << 18, 8, 64
#: Vectors a side of which the cosines are worked out at once; candidates a vector up to which each is looked at alone.
TILE, SPARSE = 1024, 16
#: The largest cosine in millionths; in place of one: with a null vector; of no partner.
MOST, NULL, NONE = 1_000_000, -2_000_000, -3_000_000
#: By how much rounding each cosine to six digits can move a mean, and the error of its sum.
MOVES = 5.01e-7


class Block:
    """Vectors of one length (-1: null vectors) in ascending order of their ids."""

    def __init__(self, size: int, ids: np.ndarray, data: np.ndarray):
        self.size, self.ids = size, ids
        x = data.reshape(len(ids), max(size, 0)).astype(np.float64)
        x[~np.isfinite(x).all(1)] = 0
        # by a power of two, so that squares neither overflow nor vanish and no digit is lost
        self.x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
        self.norm2 = np.einsum("ij,ij->i", self.x, self.x)
        self.unit = np.divide(self.x, np.sqrt(self.norm2)[:, None], out=np.zeros_like(self.x), where=self.norm2[:, None] > 0)
        self.short = self.unit.astype(np.float32)


def _bounded(dot: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines of products and products of squared norms."""
    return np.clip(np.divide(dot, np.sqrt(norms), out=np.zeros_like(dot), where=norms > 0), -1, 1)


def _millionths(cosine: np.ndarray) -> np.ndarray:
    """Rounded to six digits, halves away from zero."""
    y = np.abs(cosine) * 1e6
    whole = np.floor(y)
    whole += y - whole >= 0.5
    return np.copysign(whole, cosine, out=whole)


def _tile(one: Block, two: Block, a: slice, b: slice) -> np.ndarray:
    return _millionths(_bounded(one.x[a] @ two.x[b].T, np.outer(one.norm2[a], two.norm2[b])))


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an id of a is that of b, which is in order."""
    low, n = np.searchsorted(b, a), np.searchsorted(b, a, "right") - np.searchsorted(b, a)
    return np.repeat(np.arange(len(a)), n), np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


def _slices(n: int) -> list[slice]:
    return [slice(i, min(i + TILE, n)) for i in range(0, n, TILE)]


class Best:
    """The k best partners so far of each vector of a block: larger cosines first, then smaller ids."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.score = np.full((len(block.ids), k), NONE, np.int64)
        self.ids = np.full((len(block.ids), k), np.iinfo(np.int64).max)

    def take(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        least = self.score[row, -1]
        better = (score > least) | (score == least) & (ids < self.ids[row, -1])
        rows, row, ids, score = np.unique(row[better]), row[better], ids[better], score[better]
        row, ids, score = np.append(np.repeat(rows, self.k), row), np.append(self.ids[rows].ravel(), ids), np.append(self.score[rows].ravel(), score)
        order = np.lexsort((ids, -score, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.ids[rows], self.score[rows] = ids[order].reshape(-1, self.k), score[order].reshape(-1, self.k)

    def meet(self, two: Block) -> None:
        one = self.block
        if one.size != two.size or one.size < 0:  # all alike: the first ids
            low, high = np.searchsorted(two.ids, one.ids)[:, None], np.searchsorted(two.ids, one.ids, "right")[:, None]
            spot = np.arange(self.k)[None, :]
            spot = spot + (spot >= low) * (high - low)
            i, j = np.nonzero(spot < len(two.ids))
            self.take(i, two.ids[spot[i, j]], np.full(len(i), NULL if min(one.size, two.size) < 0 else 0))
            return
        for a in _slices(len(one.ids)):
            for b in _slices(len(two.ids)):
                i, j = self._candidates(two, a, b)
                i, j = i + a.start, j + b.start
                score = _millionths(_bounded(np.einsum("ij,ij->i", one.x[i], two.x[j]), one.norm2[i] * two.norm2[j]))
                self.take(i, two.ids[j], score.astype(np.int64))

    def _candidates(self, two: Block, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Places in the tile that hold all which can be among the best; the own id is none. Single precision leaves out the most, with a margin for its error."""
        one, last, ends = self.block, self.score[a, -1], self.ids[a, -1]
        if (last == MOST).all():  # only smaller ids are better
            b = slice(b.start, min(b.stop, int(np.searchsorted(two.ids, ends.max()))))
        full = (last == MOST) & (ends <= two.ids[b.start])
        if b.stop <= b.start or full.all():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = b.stop - b.start
        near, own = one.short[a] @ two.short[b].T, _equal(one.ids[a], two.ids[b])
        near[own] = -9
        error = (one.size + 8) * 6e-8
        least = (last - 0.5) * 1e-6 - error - 1e-7
        if (new := last <= NULL).any():
            least[new] = np.partition(near[new], width - self.k, axis=1)[:, width - self.k] - 2 * error - 1.1e-6 if width > self.k else -2
        least[full] = 9
        hits = np.flatnonzero((near >= np.maximum(least, -2).astype(np.float32)[:, None]).ravel())
        if len(hits) <= SPARSE * len(near):
            return np.divmod(hits, width)
        score, row = _tile(one, two, a, b), np.arange(len(near))
        score[own] = NONE
        found = []
        for _ in range(min(self.k, width)):
            j = score.argmax(1)  # of equals the first, of the smallest id
            some = score[row, j] > NONE
            found.append((row[some], j[some]))
            score[row, j] = NONE
        return tuple(np.concatenate(x) for x in zip(*found))


class Total:
    """Of each vector of a block: the sum of its cosines in millionths, their number, and rows of other ids met."""

    def __init__(self, block: Block):
        self.block = block
        self.sum, self.n, self.met = (np.zeros(len(block.ids), np.int64) for _ in range(3))

    def meet(self, two: Block) -> None:
        one = self.block
        others = len(two.ids) - (np.searchsorted(two.ids, one.ids, "right") - np.searchsorted(two.ids, one.ids))
        self.met += others
        if min(one.size, two.size) < 0:
            return
        self.n += others
        if one.size != two.size:
            return
        for a in _slices(len(one.ids)):
            for b in _slices(len(two.ids)):
                score = _tile(one, two, a, b)
                score[_equal(one.ids[a], two.ids[b])] = 0
                self.sum[a] += score.sum(1).astype(np.int64)


# --- tables -----------------------------------------------------------------------------------------


def _rows(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """id, vec of the rows with an id, kept; how many, and how many blocks they need."""
    single = dict(vectors.dtypes)["vec"] == "array<float>"
    rows = vectors.where("id is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>" if single else "array<double>").alias("vec"))
    seen = Observation()
    kept = store(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("vec").isNotNull(), F.size("vec"))), F.lit(0)).alias("cells")))
    n, cells = seen.get["n"], seen.get["cells"]
    return kept, n, max(1, -(-n // BLOCK), -(-cells // CELLS))


def _kind(rows: DataFrame) -> str:
    return "f4" if dict(rows.dtypes)["vec"] == "array<float>" else "f8"


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """number, size, ids, data: a row for each length of vectors in each of the blocks that rows are dealt into."""
    kind = _kind(rows)
    importable(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks().sort_by("id")
        ids, vec = whole["id"].to_numpy(), whole["vec"].combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(vec), -1).to_numpy(zero_copy_only=False)
        out = []
        for size in np.unique(lengths):
            spots = np.flatnonzero(lengths == size)
            data = pc.fill_null(vec.take(pa.array(spots)).flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(kind).tobytes() if size > 0 else b""
            out.append({"number": TaskContext.get().partitionId(), "size": int(size), "ids": ids[spots].astype("i8").tobytes(), "data": data})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("number", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())]))

    return store(rows.repartition(blocks).mapInArrow(pack, "number long, size long, ids binary, data binary"))


def _block(batch: pa.RecordBatch, row: int, side: str, kind: str) -> Block:
    size, ids, data = (batch.column(f"{side}_{c}")[row] for c in ("size", "ids", "data"))
    return Block(size.as_py(), np.frombuffer(ids.as_py(), "i8"), np.frombuffer(data.as_py(), kind))


def _met(left: DataFrame, lefts: int, right: DataFrame, rights: int) -> DataFrame:
    """Each block of left beside each of right."""
    parts = min(rights, max(-(-rights // MEETS), -(-TASKS // lefts)))
    one = left.repartitionByRange(lefts, "number").select(*[F.col(c).alias(f"one_{c}") for c in left.columns])
    two = right.repartitionByRange(parts, "number").select(*[F.col(c).alias(f"two_{c}") for c in right.columns])
    return one.crossJoin(two.hint("shuffle_replicate_nl"))


def _gathered(met: DataFrame, kind: str, start, answer, schema: str) -> DataFrame:
    """answer() of what start() of each left block has gathered from the right blocks of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            for row in range(batch.num_rows):
                if (now := (batch.column("one_number")[row].as_py(), batch.column("one_size")[row].as_py())) != key:
                    if state is not None:
                        yield answer(state)
                    key, state = now, start(_block(batch, row, "one", kind))
                state.meet(_block(batch, row, "two", kind))
        if state is not None:
            yield answer(state)

    return met.mapInArrow(run, schema)


def best_partners(vectors: DataFrame, k: int) -> DataFrame:
    """node, other, cosine of vectors(id, vec): each id's k most alike rows of other ids, ties to the smaller id."""
    rows, _, blocks = _rows(vectors)
    kind, packed = _kind(rows), _packed(rows, blocks)
    drop(rows)

    def answer(best: Best) -> pa.RecordBatch:
        i, j = np.nonzero(best.score > NONE)
        score = best.score[i, j]
        return pa.RecordBatch.from_arrays([pa.array(best.block.ids[i]), pa.array(best.ids[i, j]), pa.array(score / 1e6, mask=score == NULL)], ["node", "other", "cosine"])

    found = _gathered(_met(packed, blocks, packed, blocks), kind, lambda block: Best(block, k), answer, "node long, other long, cosine double")
    order = Window.partitionBy("node").orderBy(F.desc_nulls_last("cosine"), "other")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def _sums(packed: DataFrame, kind: str) -> dict[int, tuple[int, np.ndarray]]:
    """By length: vectors, and the sum of the unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block = _block(batch, row, "one", kind)
                n, x = sums.get(block.size, (0, 0.0))
                sums[block.size] = n + len(block.ids), x + block.unit.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.tolist() for _, x in sums.values()], pa.list_(pa.float64()))], ["size", "n", "total"])

    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in packed.select(*[F.col(c).alias(f"one_{c}") for c in packed.columns]).mapInArrow(run, "size long, n long, total array<double>").toLocalIterator():
        n, x = out.get(r["size"], (0, 0.0))
        out[r["size"]] = n + r["n"], x + np.array(r["total"])
    return out


def mean_cosines(vectors: DataFrame, digits: int) -> DataFrame:
    """id, mean of vectors(id, vec): the mean of an id's cosines with all rows of other ids, as it is to be rounded to so many digits.

    A vector's cosines add up to its product with the sum of all unit vectors. Only means that rounding
    each cosine could carry over a bound of their last digit, and ids of several rows, meet every row.
    """
    rows, n, blocks = _rows(vectors)
    kind, packed = _kind(rows), _packed(rows, blocks)
    sums = _sums(packed, kind)
    whole = sum(count for size, (count, _) in sums.items() if size >= 0)
    step = 10.0**digits

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = _block(batch, row, "one", kind)
                total = (block.unit * (sums[block.size][1] - block.unit)).sum(1)
                mean = total / max(1, whole - 1)
                none = np.full(len(mean), block.size < 0 or whole < 2)
                y = mean * step
                near = (np.abs(y - np.floor(y) - 0.5) <= MOVES * step) & ~none
                yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(mean, mask=none), pa.array(near)], ["id", "mean", "near"])

    each = packed.select(*[F.col(c).alias(f"one_{c}") for c in packed.columns]).mapInArrow(along, "id long, mean double, near boolean")
    means = store(each.groupBy("id").agg(F.max("mean").alias("mean"), (F.max("near") | (F.count(F.lit(1)) > 1)).alias("again")))
    asked, _, lefts = _rows(rows.join(means.where("again").select("id"), "id", "left_semi"))
    drop(rows)

    def answer(total: Total) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (total.block.ids, total.sum, total.n, total.met)], ["id", "total", "n", "met"])

    found = _gathered(_met(_packed(asked, lefts), lefts, packed, blocks), kind, Total, answer, "id long, total long, n long, met long")
    again = found.groupBy("id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("met").alias("met")).where("met > 0")
    once = means.where("not again").select("id", "mean").where(F.lit(n > 1))
    return once.unionByName(again.select("id", F.when(F.col("n") > 0, F.col("total") / 1e6 / F.col("n")).alias("mean")))
