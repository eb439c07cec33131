"""What the training-data operators share: shared-folder tables and byte-level word hashing.

Texts are hashed as UTF-8 bytes in numpy, whole and in bounded slices, so that a
Python worker holds a few MB beside the Arrow batch, however long a text is. A word's hash takes
eight bytes at a time through a multiply-xor round, so no two words of a rule-made family have
one hash but by chance (1 in 2^64 a pair); where a match must be certain, bytes are compared.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import components, importable, shared_dir  # noqa: F401

#: Bytes of text hashed at a time.
SLICE = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes up to which a written table is broadcast; beyond it Spark joins by shuffle.
BROADCAST_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started; bound Arrow batches by bytes, as texts may be long."""
    if int(spark.conf.get(_BATCH).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    importable(spark)
    return spark


def tidy(function: Callable) -> Callable:
    """A mapInArrow function that hands freed memory back once its partition is done: workers are reused for hours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder, under a name that tells what it is, and read it back: cuts lineage, survives lost executors.

    Cells that are packed already are better written without compression, which takes buffers outside the heap as large as the cells.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a hash table."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value) + 16
    elif isinstance(kind, T.ArrayType):
        fixed = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType))
        size = F.size(value) * 8 + 16 if fixed else F.aggregate(value, F.lit(16).cast("long"), lambda total, x: total + _bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        size = sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if the bytes of its values, all counted, are within the bound; else as it is."""
    each = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_BYTES else df


# --- words of UTF-8 text -------------------------------------------------------------------------

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Longer words are hashed one by one.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: Which bytes of a number of eight belong to a word that has 0 to 8 bytes left.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first lowest; data has eight bytes of padding."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def hash_ranges(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range data[start : start + size]; data has eight bytes of padding."""
    view = eights(data)
    out = mix(view[starts] & _KEEP[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _GOLD
    out = mix(out)
    left = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    at = 8
    while len(left):
        out[left] = mix(out[left] ^ (view[starts[left] + at] & _KEEP[np.minimum(sizes[left] - at, 8)]))
        at += 8
        left = left[sizes[left] > at]
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : starts[i] + sizes[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_ranges(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the byte ranges of one size at a_starts of a and b_starts of b are equal; both are padded."""
    one, two = eights(a), eights(b)
    keep = _KEEP[np.minimum(sizes, 8)]
    same = (one[a_starts] & keep) == (two[b_starts] & keep)
    left = np.flatnonzero(same & (sizes > 8) & (sizes <= LONG))
    at = 8
    while len(left):
        keep = _KEEP[np.minimum(sizes[left] - at, 8)]
        same[left] = (one[a_starts[left] + at] & keep) == (two[b_starts[left] + at] & keep)
        at += 8
        left = left[same[left] & (sizes[left] > at)]
    for i in np.flatnonzero(same & (sizes > LONG)).tolist():
        n = sizes[i]
        same[i] = np.array_equal(a[a_starts[i] : a_starts[i] + n], b[b_starts[i] : b_starts[i] + n])
    return same


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def byte_class(is_word: Callable[[int], bool]) -> np.ndarray:
    """Whether each byte, A-Z read as a-z, belongs to words."""
    return np.array([is_word(b + 32 if 65 <= b < 91 else b) for b in range(256)])


#: A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words as runs of anything but ASCII white space.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words as runs of a-z, 0-9 and every byte of non-ASCII characters.
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_ranges(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of all texts starts and ends in data; no word reaches over two texts."""
    starts, ends, n = [], [], len(data)
    for at in range(0, n, SLICE):
        end = min(n, at + SLICE)
        inside = is_word[data[at:end]]
        before = np.empty(end - at, bool)
        before[0] = at > 0 and is_word[data[at - 1]]
        before[1:] = inside[:-1]
        edge = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, end, "left")] - at
        first, stop = inside & ~before, before & ~inside
        first[edge], stop[edge] = inside[edge], before[edge]
        starts.append(np.flatnonzero(first) + at)
        ends.append(np.flatnonzero(stop) + at)
    if n and is_word[data[-1]]:
        ends.append(np.array([n]))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the first word's index of each text (and the end)."""
    starts, ends = word_ranges(data, offsets, is_word)
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + SLICE, SLICE))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if b > a:  # a slice of lower-cased bytes, up to the end of its last word
            low = int(starts[a])
            out[a:b] = hash_ranges(padded(LOWER[data[low : int(ends[b - 1])]]), starts[a:b] - low, ends[a:b] - starts[a:b])
    return out, np.searchsorted(starts, offsets)


def hash_word(word: str, is_word: np.ndarray = SPACED) -> int:
    """The hash that words() gives to one word."""
    data, offsets = utf8(pa.array([word]))
    found, _ = words(data, offsets, is_word)
    assert len(found) == 1, "not one word"
    return int(found[0])


_COEF = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row; fewer words than k: of all of them as one (none: empty)."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += hashes[j : n - k + 1 + j] * _COEF[j % 64]
    return mix(out + np.uint64(k))


def arrow_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
