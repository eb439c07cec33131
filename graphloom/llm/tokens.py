"""Token ids: a piece-cached encoder, and directly addressable codes with random access to any token.

Encoding gives exactly the ids of the tokenizers library. Byte-level BPE never merges across
the pieces of its pre-tokenizer, so texts are cut into pieces in numpy, the library encodes
each distinct piece once per worker, and ids are gathered from that table. A piece is looked up
by hash and its bytes are compared with those of the entry before the entry counts. A tokenizer of
another kind, or a text that holds one of its added tokens, goes to the library whole.

A shard of the file format holds whole documents in ascending doc_id order:

    magic, version, levels, documents, ids | doc_ids | null flags | ends of documents |
    per level: entries, chunks of 8 bits, and (but for the last level) a continuation
    bitmap with a rank directory of one count per 512 bits | crc32 of all before

Level 1 has the lowest 8 bits of every id; where the bitmap has a 1, the id goes on in the
next level at the index that rank gives. So the i-th id is read with a rank per level, ids a to b
with two, and no block is decoded. Each shard is a plain file in the shared folder, of any store that
pyarrow opens (file, hdfs, s3, gs); a table lists the files that committed tasks wrote, so
those of a lost or repeated attempt are never read. Documents are read back by rank.

Defined cases: null and empty texts have the end id only; repeated rows are encoded
each; rows without doc_id come first; rows of equal or no doc_id follow each other in any order
and may be dealt over several tasks; an empty table gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

END_ID = 0
SHARD_IDS = 1 << 20
CACHE = 1_500_000
SLOTS = 1 << 20
CHARS = 1 << 20
JOINED = 500


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


# --- encoding ------------------------------------------------------------------------------------

_SPACE, _LETTER, _NUMBER, _OTHER, _NONE = 0, 1, 2, 3, 255
#: Code points with the Unicode property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: dict[int, np.ndarray] = {}


def _class_table(top: int) -> np.ndarray:
    """The class of each code point up to `top`: a table of those below U+3000, or of all."""
    size = 0x3000 if top < 0x3000 else 0x110000
    if size not in _classes:
        import unicodedata

        kinds = {"L": _LETTER, "N": _NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(size)), np.uint8, size)
        table[[x for x in _WHITE if x < size]] = _SPACE
        _classes[size] = table
    return _classes[size]


def pieces(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level BPE start, in texts one behind the other that start at `firsts`.

    A piece is a contraction, or a run of letters, numbers or other marks with the space before
    it, or white space up to the character before such a run.
    """
    n = len(codes)
    kind = _class_table(int(codes.max()))[codes]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[firsts] = _NONE
    after = np.empty_like(kind)
    after[:-1] = kind[1:]
    after[n - 1] = _NONE
    after[firsts[firsts > 0] - 1] = _NONE
    space, blank = kind == _SPACE, np.zeros(n, bool)
    blank[1:] = codes[:-1] == 0x20
    blank[firsts] = False
    change = kind != before
    start = change & (space | ~blank)
    start |= space & (after != _SPACE) & (after != _NONE)
    marks = np.flatnonzero((codes == 0x27) & start & (after == _LETTER))
    if len(marks):
        one = codes[marks + 1]
        two = np.where(marks + 2 < n, codes[np.minimum(marks + 2, n - 1)], 0)
        two = np.where(after[marks + 1] == _NONE, 0, two)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for at, size in ((marks[short], 2), (marks[long], 3)):
            start[at + 1] = False
            ahead = at[(at + size < n)] + size
            ahead = ahead[before[ahead] != _NONE]
            start[ahead[kind[ahead] == _LETTER]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of whole texts; one per worker process and vocabulary file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            about = json.load(file)
        cut = about.get("pre_tokenizer") or {}
        self.by_piece = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not about.get("normalizer") and not about.get("truncation") and not about.get("padding")
        self.added = [x["content"] for x in about.get("added_tokens", [])]
        self._reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _reset(self) -> None:
        self.flat = np.zeros(1 << 18, np.uint32)
        self.letters = np.zeros(1 << 18, np.uint8)
        #: of each row: first id, number of ids, first byte, number of bytes
        self.about = np.zeros((4, 1 << 16), np.int32)
        self.pieces = self.used = self.bytes = 0
        self.keys = [np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)]
        self.rows = [np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one behind the other, number of each piece's ids), from the library.

        Pieces of a space and letters stay apart when they are joined, so JOINED of them are encoded at once and the
        library's word numbers tell whose ids are whose; others go one by one.
        """
        words = [i for i, t in enumerate(texts) if len(t) > 1 and t[0] == " " and t[1:].isalpha()]
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        ids: list[np.ndarray] = []
        order, lengths = [], []
        single = set(range(len(texts))) - set(words)
        for group, got in zip(groups, self.tokenizer.encode_batch(["".join([texts[i] for i in group]) for group in groups], add_special_tokens=False)):
            n = np.bincount(np.array(got.word_ids, np.int64), minlength=len(group)) if len(got) else np.zeros(0, np.int64)
            if len(n) != len(group):
                single.update(group)
                continue
            ids.append(np.array(got.ids, np.uint32))
            order.append(group)
            lengths.append(n)
        rest = sorted(single)
        lists = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        ids.append(np.fromiter(chain.from_iterable(lists), np.uint32))
        order.append(rest)
        lengths.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        place, size, flat = np.concatenate([np.array(x, np.int64) for x in order]), np.concatenate(lengths), np.concatenate(ids)
        back = np.argsort(place)
        begin, n = (np.cumsum(size) - size)[back], size[back]
        return flat[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n

    def _add(self, some: list[bytes]) -> np.ndarray:
        """Encode pieces with the library; their rows in the table."""
        ids, lengths = self._library([x.decode() for x in some])
        sizes = np.fromiter(map(len, some), np.int32, len(some))
        total, at, size = len(ids), self.pieces, int(sizes.sum())
        while at + len(some) > self.about.shape[1]:
            self.about = np.hstack([self.about, np.zeros_like(self.about)])
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while self.bytes + size + 8 > len(self.letters):
            self.letters = np.resize(self.letters, 2 * len(self.letters))
        self.flat[self.used : self.used + total] = ids
        self.letters[self.bytes : self.bytes + size] = np.frombuffer(b"".join(some), np.uint8)
        self.about[:, at : at + len(some)] = [self.used + np.cumsum(lengths) - lengths, lengths, self.bytes + np.cumsum(sizes) - sizes, sizes]
        self.pieces, self.used, self.bytes = at + len(some), self.used + total, self.bytes + size
        return np.arange(at, self.pieces)

    def _rows(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The table row of each piece: two places to look in by hash; what is in neither is encoded."""
        key = c.hash_ranges(data, starts, sizes) | np.uint64(1 << 63)
        mask = np.uint64(SLOTS - 1)
        slots = [(key & mask).astype(np.int64), ((key >> np.uint64(24)) & mask).astype(np.int64)]
        row = self.rows[0][slots[0]].astype(np.int64)
        missed = np.flatnonzero(self.keys[0][slots[0]] != key)
        other = slots[1][missed]
        row[missed] = self.rows[1][other]
        missed = missed[self.keys[1][other] != key[missed]]
        if len(missed):
            distinct, at, inverse = np.unique(key[missed], return_index=True, return_inverse=True)
            if self.pieces + len(distinct) > CACHE and self.pieces:
                self._reset()
                return self._rows(data, starts, sizes)
            first = missed[at]
            found = self._add([data[a : a + n].tobytes() for a, n in zip(starts[first].tolist(), sizes[first].tolist())])
            taken = self.keys[0][slots[0][first]] != 0
            for way, some in ((0, ~taken), (1, taken)):
                own = slots[way][first[some]]
                self.rows[way][own] = found[some]
                self.keys[way][own] = distinct[some]
                # of pieces that share a place the last one stays; rows and keys are written in the same order
            row[missed] = found[inverse]
        same = self.about[3][row] == sizes
        same[same] = c.same_ranges(data, starts[same], self.letters, self.about[2][row[same]].astype(np.int64), sizes[same])
        odd = np.flatnonzero(~same)
        if len(odd):  # another piece of this hash has the entry
            row[odd] = self._add([data[a : a + n].tobytes() for a, n in zip(starts[odd].tolist(), sizes[odd].tolist())])
        return row

    def _some(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray | None, np.ndarray]:
        joined = "".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not joined:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = pieces(codes, np.unique(bounds[:-1][sizes > 0]))
        data = np.frombuffer(joined.encode() + bytes(8), np.uint8)
        begin = starts
        if len(data) - 8 > len(codes):  # a character's bytes but for the first are 10xxxxxx
            begin = np.flatnonzero((data[:-8] & 0xC0) != 0x80)[starts]
        row = self._rows(data, begin, np.diff(begin, append=len(data) - 8))
        lengths = self.about[1][row].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(upto[np.searchsorted(starts, bounds)])
        if not want_ids:
            return None, counts
        spot = np.repeat(self.about[0][row] - upto[:-1], lengths)
        spot += np.arange(len(spot))
        return self.flat[spot], counts

    def encode(self, texts: list[str | None], want_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, or none; number of ids of each)."""
        ids, counts = [], []

        def flush(some: list[str]) -> None:
            if some:
                got, n = self._some(some, want_ids)
                ids.append(got)
                counts.append(n)
                some.clear()

        held: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if not self.by_piece or any(x in text for x in self.added):
                flush(held)
                size = 0
                got = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                ids.append(got if want_ids else None)
                counts.append(np.array([len(got)], np.int64))
                continue
            held.append(text)
            size += len(text)
            if size >= CHARS:
                flush(held)
                size = 0
        flush(held)
        return np.concatenate(ids) if want_ids and ids else np.zeros(0, np.uint32), np.concatenate(counts) if counts else np.zeros(0, np.int64)


# --- directly addressable codes -----------------------------------------------------------------

_MAGIC = b"DACS"
_HEAD = struct.Struct("<4sHHQQ")
_BLOCK = 512


class Level:
    """Chunks of 8 bits, and for all but the last level which entries go on, with a rank directory."""

    def __init__(self, chunks: np.ndarray, bits: np.ndarray | None, ranks: np.ndarray | None):
        self.chunks, self.bits, self.ranks = chunks, bits, ranks

    def goes_on(self, i: int) -> bool:
        return self.bits is not None and bool(self.bits[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """How many entries before i go on."""
        block = i // _BLOCK
        whole, rest = self.bits[block * _BLOCK // 8 : i >> 3], i & 7
        inside = int(np.bitwise_count(whole).sum())
        if rest:
            inside += (int(self.bits[i >> 3]) & ((1 << rest) - 1)).bit_count()
        return int(self.ranks[block]) + inside


def pack(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray) -> bytes:
    """A shard of whole documents; ends: of each document among the ids."""
    left, parts, levels = ids.astype(np.uint64), [], 0
    while True:
        levels += 1
        more = left >> np.uint64(8)
        on = more > 0
        chunk = (left & np.uint64(255)).astype(np.uint8)
        parts += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        going = bool(on.any())
        parts.append(struct.pack("<B", going))
        if not going:
            break
        bits = np.packbits(on, bitorder="little")
        per = np.add.reduceat(on.astype(np.int64), np.arange(0, len(on), _BLOCK))
        parts += [bits.tobytes(), np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u8").tobytes()]
        left = more[on]
    body = _HEAD.pack(_MAGIC, 1, levels, len(doc_ids), len(ids)) + doc_ids.astype("<i8").tobytes() + np.packbits(nulls, bitorder="little").tobytes() + ends.astype("<u8").tobytes() + b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A packed shard: len(), shard[i], document(k) and ids(), without a copy of the bytes."""

    def __init__(self, data: bytes | memoryview | pa.Buffer, verify: bool = True):
        view = memoryview(data)
        magic, version, _, docs, self.n_ids = _HEAD.unpack_from(view, 0)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a shard of directly addressable codes")
        if verify and zlib.crc32(view[:-4]) != struct.unpack_from("<I", view, len(view) - 4)[0]:
            raise ValueError("the shard's checksum doesn't fit")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids = take("<i8", docs)
        self.nulls = np.unpackbits(take("u1", -(-docs // 8)), count=docs, bitorder="little").astype(bool)
        self.ends = take("<u8", docs)
        self.levels: list[Level] = []
        while True:
            n = int(take("<u8", 1)[0])
            chunks = take("u1", n)
            if not take("u1", 1)[0]:
                self.levels.append(Level(chunks, None, None))
                break
            self.levels.append(Level(chunks, take("u1", -(-n // 8)), take("<u8", -(-n // _BLOCK))))

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for level in self.levels:
            value |= int(level.chunks[i]) << shift
            if not level.goes_on(i):
                break
            i, shift = level.rank(i), shift + 8
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b: what of them goes on lies in one piece of the next level, from the rank of a to that of b."""
        out, where, shift = np.zeros(b - a, np.uint32), slice(None), 0
        for level in self.levels:
            chunk = level.chunks[a:b].astype(np.uint32) << np.uint32(shift)
            out[where] |= chunk
            if level.bits is None or b <= a:
                break
            on = np.unpackbits(level.bits[a >> 3 : -(-b // 8)], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            spots = np.arange(len(out)) if shift == 0 else where
            where = spots[on]
            a, shift = level.rank(a), shift + 8
            b = a + len(where)
        return out

    def ids(self) -> np.ndarray:
        return self.slice(0, self.n_ids)

    def bounds(self, k: int) -> tuple[int, int]:
        return int(self.ends[k - 1]) if k else 0, int(self.ends[k])

    def document(self, k: int) -> np.ndarray:
        return self.slice(*self.bounds(k))


def save_shard(uri: str, data: bytes) -> None:
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0])
    with store.open_output_stream(path) as file:
        file.write(data)


def open_shard(uri: str, verify: bool = False) -> Shard:
    """A shard's file; one on a local disk is mapped into memory, so that reading a token touches a few pages."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return Shard(pa.memory_map(path).read_buffer(), verify)
    with store.open_input_file(path) as file:
        return Shard(file.read_buffer(), verify)


def _uri(folder: str) -> str:
    """A folder as pyarrow names it: file:/x and /x are file:///x."""
    return "file:///" + folder.removeprefix("file:").lstrip("/") if "://" not in folder or folder.startswith("file:") else folder


def write_shards(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode documents in ascending doc_id order into shard files in the shared folder; the table of these files.

    Columns: part, seq (the order of shards), n_docs, n_ids, file. Each task packs its range of
    doc_ids; a shard ends with the document that brings it to SHARD_IDS ids.
    """
    spark = c.prepare(docs.sparkSession)
    path = path or vocabulary()
    folder = _uri(f"{c.shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.spark_partition_id().alias("part"))
    order = rows.repartitionByRange("doc_id", "tie", "part").sortWithinPartitions("doc_id", "tie", "part").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = Encoder.of(path), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ids, counts, doc_ids, nulls = (np.concatenate(x) for x in zip(*held))
            file = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            save_shard(file, pack(ids, doc_ids, nulls, np.cumsum(counts)))
            cells = [[part], [seq], [len(doc_ids)], [len(ids)], [file]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["part", "seq", "n_docs", "n_ids", "file"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, counts = encoder.encode(some.column("text").to_pylist())
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                key = some.column("doc_id")
                held.append((ids, counts + 1, key.fill_null(0).to_numpy(), np.array(key.is_null())))
                size += len(ids)
                if size >= SHARD_IDS:
                    yield shard()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield shard()

    return c.materialize(order.mapInArrow(c.tidy(encode), "part long, seq long, n_docs long, n_ids long, file string"), "shard-files")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back by rank from the files of a table of shards.

    Only a total per task of the writer reaches the driver.
    """
    spark = shards.sparkSession
    c.prepare(spark)
    before, rows = 0, []
    for r in sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        rows.append((r["part"], before))
        before += r["n"]
    bases = spark.createDataFrame(rows, "part long, base long")
    prior = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = shards.withColumn("prior", prior).join(F.broadcast(bases), "part").select((F.col("base") + F.col("prior")).alias("base"), "file")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, file in zip(batch.column("base").to_pylist(), batch.column("file").to_pylist()):
                shard = open_shard(file, verify=True)
                ends = shard.ends.astype(np.int64)
                first = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(shard.document(k).astype("<u4")) for k in range(len(ends))]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids.astype(np.int64), mask=shard.nulls), pa.array(base + first), pa.array(ends - first), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for every few files, so that reading is dealt over the cluster
    spread = placed.repartition(max(1, min(shards.count(), 2 * spark.sparkContext.defaultParallelism)), "file") if rows else placed
    return spread.mapInArrow(c.tidy(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write documents as shards and read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_documents(write_shards(docs, path, end_id))


# --- exact length histogram ---------------------------------------------------------------------

_STEP = 1024


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """length, n_docs: documents by number of ids (null and empty texts: 0). Counts within each batch first."""
    c.prepare(docs.sparkSession)
    path = path or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            _, counts = encoder.encode(batch.column("text").to_pylist(), want_ids=False)
            length, n = np.unique(counts, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n)], ["length", "n_docs"])

    return docs.select("text").mapInArrow(c.tidy(count), "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit_tokens with docs_over, tokens_over, docs_within and tokens_truncated for any context limits, from the rows of context_limits().

    A limit's answer is that of the longest occurring length within it; one aggregation for all limits.
    """
    facts = ("docs_over", "tokens_over", "total_docs", "total_tokens")
    best = [F.max_by(F.struct(*facts), F.when(F.col("limit_tokens") <= x, F.col("limit_tokens"))).alias(f"r{i}") for i, x in enumerate(limits)]
    whole = sums.agg(F.max("total_docs").alias("docs"), F.max("total_tokens").alias("tokens"), *best).where("docs is not null")
    rows = [F.struct(F.lit(x).cast("long").alias("limit_tokens"), *[F.coalesce(F.col(f"r{i}.{f}"), F.col("docs" if "docs" in f else "tokens")).alias(f) for f in facts]) for i, x in enumerate(limits)]
    out = whole.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("limit_tokens", "docs_over", "tokens_over", (F.col("total_docs") - F.col("docs_over")).alias("docs_within"), (F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("limit_tokens")).alias("tokens_truncated"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, limit_tokens: the least length that at least this share of the documents don't exceed, for any shares."""
    # 0 is met by the shortest length, as is every share up to its own
    best = [F.min(F.when(F.col("docs_within") >= F.lit(q) * F.col("total_docs"), F.col("limit_tokens"))).alias(f"q{i}") for i, q in enumerate(shares)]
    rows = [F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("limit_tokens")) for i, q in enumerate(shares)]
    return sums.agg(*best).select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("limit_tokens is not null")


def context_limits(histogram: DataFrame) -> DataFrame:
    """A row for each length that occurs, read as a context limit.

    limit_tokens, n_docs of that length; docs_over and tokens_over: documents longer than the limit
    and their ids; docs_within and share_within: those that fit and their share (the limit is that
    quantile); tokens_within; tokens_truncated: ids left if every document is cut at the limit;
    total_docs and total_tokens. Suffix sums run within steps of 1,024 lengths and then over the
    few steps, so no task sorts the whole histogram.
    """
    step = F.floor(F.col("length") / _STEP)
    # the two sums below read it: an exact table is worth its few rows
    table = c.materialize(histogram.select("length", "n_docs", step.alias("step")), "lengths")
    steps = table.groupBy("step").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    after = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nothing = F.lit(0).cast("long")
    steps = steps.select("step", F.coalesce(F.sum("d").over(after), nothing).alias("d_after"), F.coalesce(F.sum("t").over(after), nothing).alias("t_after"), F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    longer = Window.partitionBy("step").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    inside = table.select("*", F.coalesce(F.sum("n_docs").over(longer), nothing).alias("d_in"), F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(longer), nothing).alias("t_in"))
    both = inside.join(steps, "step").select("*", (F.col("d_in") + F.col("d_after")).alias("docs_over"), (F.col("t_in") + F.col("t_after")).alias("tokens_over"))
    within = F.col("total_docs") - F.col("docs_over")
    return both.select(
        F.col("length").alias("limit_tokens"),
        "n_docs",
        "docs_over",
        "tokens_over",
        within.alias("docs_within"),
        (within / F.col("total_docs")).alias("share_within"),
        (F.col("total_tokens") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("length")).alias("tokens_truncated"),
        "total_docs",
        "total_tokens",
    )
