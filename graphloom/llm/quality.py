"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)),
the sum-of-squares identity, so a document costs time linear in its words.

Inputs of a score are the text and its metadata field n_chars, never labels, lang,
source or doc_id. Training reads at most TRAIN_ROWS labelled documents, the first by a hash
of their id, none longer than TRAIN_BYTES; every document is scored on its whole text.

Defined cases: null and empty texts have no words and are scored on their statistics; a
null or absent n_chars has its own feature; repeated rows get equal scores; labels that
are null or whose document is missing are ignored, of several labels of a document the
largest counts; a labelled doc_id that is repeated is learned from once; with no labelled row at all, every
score is 1. An empty table gives an empty result. Columns of any other name are left alone; score() puts its
columns in the place of those named score and predicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

SLOTS = 1 << 14
RANK = 8
TRAIN_ROWS = 12_000
TRAIN_BYTES = 64_000
EPOCHS = 6
BATCH = 64
THRESHOLD = 0.7
BINS = 12

#: Byte classes of the structure statistics: lower, upper, digit, space, line end, common marks, other marks, non-ASCII.
_KINDS = np.full(256, 6, np.uint8)
_KINDS[128:] = 7
_KINDS[0x61:0x7B], _KINDS[0x41:0x5B], _KINDS[0x30:0x3A] = 0, 1, 2
_KINDS[[0x20, 0x09]], _KINDS[[0x0A, 0x0D]] = 3, 4
_KINDS[[ord(x) for x in ".,;:'\"-()?"]] = 5
#: Upper ends of the bins of a share.
_SHARES = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.75])
_STATS = 11
WIDTH = SLOTS + (_STATS + 1) * BINS


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text has the given remainder."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder


def _statistics(data: np.ndarray, hashes: np.ndarray, unique: int) -> list[int]:
    counts = np.zeros(8, np.int64)
    for at in range(0, len(data), c.SLICE):
        counts += np.bincount(_KINDS[data[at : at + c.SLICE]], minlength=8)
    n, letters, n_words = max(1, len(data)), max(1, counts[0] + counts[1] + counts[7]), max(1, len(hashes))
    shares = [counts[1] / letters, *(counts[[2, 3, 4, 5, 6, 7]] / n), counts[6] / n_words / 4, 1 - unique / n_words]
    bins = np.searchsorted(_SHARES, shares).tolist()
    bins.append(min(BINS - 1, int(len(data) / n_words)))
    bins.append(min(BINS - 1, int(np.log2(1 + len(hashes)) * 0.8)))
    return bins


def featurize(texts: pa.Array, n_chars: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot of each feature, value of each, first feature of each document and the end)."""
    data, offsets = c.utf8(texts)
    hashes, first = c.words(data, offsets)
    slots = (hashes & np.uint64(SLOTS - 1)).astype(np.uint16)
    meta = [None] * len(texts) if n_chars is None else n_chars.to_pylist()
    index, value, ends = [], [], [0]
    base = SLOTS + BINS * np.arange(_STATS + 1)
    for i, declared in enumerate(meta):
        own = np.unique(slots[first[i] : first[i + 1]])
        bins = _statistics(data[offsets[i] : offsets[i + 1]], slots[first[i] : first[i + 1]], len(own))
        bins.append(0 if declared is None else min(BINS - 1, 1 + int(np.log2(1 + max(0, declared)) * 0.6)))
        index += [own.astype(np.int32), (base + bins).astype(np.int32)]
        value += [np.full(len(own), 1 / np.sqrt(max(1, len(own))), np.float32), np.full(len(bins), 0.5, np.float32)]
        ends.append(ends[-1] + len(own) + len(bins))
    if not index:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64)
    return np.concatenate(index), np.concatenate(value), np.array(ends, np.int64)


class FactorisationMachine:
    """Second-order factorisation machine with logistic loss, fitted by AdaGrad in small batches."""

    def __init__(self, width: int = WIDTH, rank: int = RANK):
        self.bias = 0.0
        self.linear = np.zeros(width, np.float32)
        self.factors = np.random.default_rng(7).normal(0, 0.02, (width, rank)).astype(np.float32)
        self.constant: float | None = None

    def raw(self, index: np.ndarray, value: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores before the sigmoid, and each document's factor sums; every document has a feature at least."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, ends[:-1], axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), ends[:-1])
        return self.bias + np.add.reduceat(self.linear[index] * value, ends[:-1]) + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, index: np.ndarray, value: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(ends) - 1
        if self.constant is not None or not n:
            return np.full(n, self.constant or 0.0)
        return 1 / (1 + np.exp(-self.raw(index, value, ends)[0].astype(np.float64)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rate: float = 0.15, decay: float = 1e-5) -> FactorisationMachine:
        if not len(labels):
            self.constant = 1.0
            return self
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        g_lin, g_fac, g_bias = np.full(len(self.linear), 1e-3, np.float32), np.full(self.factors.shape, 1e-3, np.float32), 1e-3
        random = np.random.default_rng(11)
        for _ in range(EPOCHS):
            order = random.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                index = np.concatenate([rows[i][0] for i in some])
                value = np.concatenate([rows[i][1] for i in some])
                lens = np.array([len(rows[i][0]) for i in some])
                ends = np.concatenate([[0], np.cumsum(lens)])
                raw, sums = self.raw(index, value, ends)
                error = (1 / (1 + np.exp(-raw)) - labels[some]).astype(np.float32) / len(some)
                ex = np.repeat(error, lens) * value
                used, back = np.unique(index, return_inverse=True)
                d_lin = np.bincount(back, ex, len(used)).astype(np.float32) + decay * self.linear[used]
                cross = np.repeat(sums, lens, axis=0) - self.factors[index] * value[:, None]
                d_fac = np.stack([np.bincount(back, ex * cross[:, f], len(used)) for f in range(cross.shape[1])], 1).astype(np.float32) + decay * self.factors[used]
                g_lin[used] += d_lin**2
                g_fac[used] += d_fac**2
                g_bias += float(error.sum()) ** 2
                self.linear[used] -= rate * d_lin / np.sqrt(g_lin[used])
                self.factors[used] -= 0.3 * rate * d_fac / np.sqrt(g_fac[used])
                self.bias -= 0.1 * rate * float(error.sum()) / np.sqrt(g_bias)
        return self


def _meta(docs: DataFrame) -> Column:
    kinds = dict(docs.dtypes)
    return F.col("n_chars").cast("long") if kinds.get("n_chars") in ("bigint", "int", "smallint", "tinyint") else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2, rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Fit on at most `rows` labelled documents outside the held-out fold."""
    c.prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    rows_of = docs.select("doc_id", "text", _meta(docs).alias("n_chars")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    pairs = rows_of.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text", "n_chars")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, value, ends = featurize(batch.column("text"), batch.column("n_chars"))
            cut = [index[a:b].astype(np.uint16).tobytes() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(cut, pa.binary())], ["doc_id", "y", "features"])

    got = pairs.mapInArrow(c.tidy(shrink), "doc_id long, y int, features binary")
    got = got.groupBy("doc_id", "y").agg(F.min("features").alias("features")).toArrow().sort_by("doc_id")
    data, y = [], got.column("y").to_numpy().astype(np.float32) if got.num_rows else np.zeros(0, np.float32)
    for cell in got.column("features"):
        index = np.frombuffer(cell.as_py(), np.uint16).astype(np.int32)
        n = len(index) - _STATS - 1
        value = np.full(len(index), 0.5, np.float32)
        value[:n] = 1 / np.sqrt(max(1, n))
        data.append((index, value))
    return FactorisationMachine().fit(data, (y > 0).astype(np.float32))


def score(docs: DataFrame, model: FactorisationMachine, keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all of docs if None), then score double and predicted int."""
    c.prepare(docs.sparkSession)
    keep = [x for x in (docs.columns if keep is None else keep) if x not in ("score", "predicted")]
    source = docs.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], F.col("text").alias("fm_text"), _meta(docs).alias("fm_meta"))
    out = source.drop("fm_text", "fm_meta").schema.add("score", "double").add("predicted", "integer")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(*featurize(batch.column("fm_text"), batch.column("fm_meta")))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*[f"k{i}" for i in range(len(keep))], "score", "predicted"])

    scored = source.mapInArrow(c.tidy(judge), out)
    return scored.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "score", "predicted")


def accept(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    c.prepare(docs.sparkSession)
    names = docs.columns
    source = docs.select(*[F.col(f"`{x}`").alias(f"k{i}") for i, x in enumerate(names)], F.col("text").alias("fm_text"), _meta(docs).alias("fm_meta"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(*featurize(batch.column("fm_text"), batch.column("fm_meta"))) >= THRESHOLD
            yield batch.select([f"k{i}" for i in range(len(names))]).filter(pa.array(good))

    kept = source.mapInArrow(c.tidy(judge), source.drop("fm_text", "fm_meta").schema)
    return kept.select(*[F.col(f"k{i}").alias(x) for i, x in enumerate(names)])
