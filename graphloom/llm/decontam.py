"""Benchmark decontamination with a distributed positional inverted index.

positional_index() writes the postings of every term of every training document as a table in the
shared folder, once, for any number of lookups. The table consists of segments of some
SEGMENT_BYTES of text: a dictionary of the segment's words (bytes and number of occurrences, in the order of
their hashes) and the positions of each word in ascending order, all packed as differences. A term's list is so split by segment, however
frequent the term; all lists that a phrase needs of a document lie in one row, so
intersections need no shuffle, and nothing grows with a hot term but the number of segments.

hits() looks phrases up. Frequencies of the benchmark's vocabulary are summed over all
segments' dictionaries; within a segment, each window starts from the positions of its
rarest term, moved by the term's offset, and is intersected with the moved lists of its other terms from
the rarest to the most frequent until nothing is left or all terms have agreed: what is left are
exact matches, and no text is read again. Positions leave a gap between documents, so no match reaches
over two. proximity_matches() sweeps the lists of terms for their least spans in any order.

Words are found by hash and taken for equal only if their bytes are: a segment gives words of one
hash entries of their own, and a lookup compares the bytes of the dictionary.

A benchmark is worked off in slices of SLICE_WORDS words, each against the index, so what every
task holds of it is bounded.

Defined cases: null and empty texts have no words, are hit by nothing and aren't contaminated;
items without words match nothing; every row of docs is judged by itself, whether its doc_id is null,
repeated or shared by other texts; repeated items count once per item_id, items without an id as
'None'; an empty benchmark leaves every document clean, an empty table gives an empty result;
columns of other names are not read by hits() and stay in decontaminate().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WINDOW = 13
SLICE_WORDS = 200_000
SEGMENT_BYTES = 1 << 20
#: Places compared at a time.
PLACES = 1 << 20


# --- the index -----------------------------------------------------------------------------------


class Dictionary:
    """Distinct words by ascending hash; words of one hash stand at the hash, then at next_hash of it, and so on."""

    def __init__(self, hashes: np.ndarray, letters: np.ndarray, ends: np.ndarray):
        self.hashes, self.letters, self.ends = hashes, letters, ends
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def find(self, hashes: np.ndarray, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The entry of each word, -1 if it isn't here; letters is padded."""
        out = np.full(len(hashes), -1, np.int64)
        left, hashes = np.arange(len(hashes)), hashes.copy()
        own = c.padded(self.letters)
        while len(left) and len(self.hashes):
            spot = np.minimum(np.searchsorted(self.hashes, hashes[left]), len(self.hashes) - 1)
            there = self.hashes[spot] == hashes[left]
            left, spot = left[there], spot[there]
            fits = (self.ends[spot] - self.starts[spot]) == sizes[left]
            fits[fits] = c.same_ranges(own, self.starts[spot[fits]], letters, starts[left[fits]], sizes[left[fits]])
            out[left[fits]] = spot[fits]
            left = left[~fits]
            hashes[left] = next_hash(hashes[left])
        return out


def next_hash(hashes: np.ndarray) -> np.ndarray:
    return c.mix(hashes + np.uint64(1))


def lower_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, padded; start, size and hash of each word; first word of each text and the end)."""
    data, offsets = c.utf8(texts)
    starts, ends = c.word_ranges(data, offsets, c.ALNUM)
    low = c.padded(c.LOWER[data])
    return low, starts, ends - starts, c.hash_ranges(low, starts, ends - starts), np.searchsorted(starts, offsets)


def dictionary(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[Dictionary, np.ndarray, np.ndarray]:
    """(distinct words, word numbers in order of entry and place, end of each entry's numbers)."""
    hashes = hashes.copy()
    while True:
        order = np.argsort(hashes, kind="stable")
        value = hashes[order]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        heads = np.flatnonzero(new)
        first = order[np.repeat(heads, np.diff(np.append(heads, len(order))))]
        same = sizes[order] == sizes[first]
        same[same] = c.same_ranges(low, starts[order[same]], low, starts[first[same]], sizes[order[same]])
        if same.all():
            break
        odd = order[~same]
        hashes[odd] = next_hash(hashes[odd])
    some = order[heads]
    upto = np.cumsum(sizes[some])
    letters = low[np.repeat(starts[some] - upto + sizes[some], sizes[some]) + np.arange(upto[-1] if len(upto) else 0)]
    return Dictionary(value[heads], letters, upto), order, np.append(heads, len(order))[1:]


_SEGMENT = "segment long, keys array<{0}>, first binary, moved binary, letters binary, letter_sizes binary, counts binary, postings binary"
#: What looking words up takes, and what finding their places takes besides.
_WORDS, _PLACES = ("moved", "letters", "letter_sizes", "counts"), ("first", "postings")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as their count and zstd of their four bytes, all first bytes first: small numbers leave zeros in a row."""
    raw = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(cell: bytes) -> np.ndarray:
    n = int.from_bytes(cell[:8], "little")
    raw = np.frombuffer(pa.decompress(cell[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def positional_index(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The segments of all documents, stored in the shared folder: what hits() and proximity_matches() read."""
    c.prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def segment() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            keys = rows.column("doc").combine_chunks()
            keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
            low, starts, sizes, hashes, first = lower_words(rows.column("text"))
            words, order, ends = dictionary(low, starts, sizes, hashes)
            row = np.searchsorted(first, order, "right") - 1
            # differences within a list pack well; each list begins with its whole first place
            place = (order + row).astype("<u4")
            step = np.diff(place, prepend=np.uint32(0))
            begins = np.concatenate([[0], ends[:-1]])[: len(ends)]
            step[begins] = place[begins]
            own_sizes = words.ends - words.starts
            # hashes follow from the bytes, unless words of one hash had to be told apart
            plain = np.array_equal(c.hash_ranges(c.padded(words.letters), words.starts, own_sizes), words.hashes)
            text = len(words.letters).to_bytes(8, "little") + pa.compress(words.letters.tobytes(), "zstd", asbytes=True)
            cells = [_packed(np.diff(first, prepend=0)), b"" if plain else words.hashes.astype("<u8").tobytes(), text, _packed(own_sizes), _packed(np.diff(ends, prepend=0)), _packed(step)]
            lists = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), lists, *[pa.array([x], pa.binary()) for x in cells]], ["segment", "keys", "first", "moved", "letters", "letter_sizes", "counts", "postings"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("text").nbytes
            if size >= SEGMENT_BYTES:
                yield segment()
                held, size, number = [], 0, number + 1
        if held:
            yield segment()

    rows = docs.select(F.col(key).alias("doc"), "text").mapInArrow(c.tidy(write), _SEGMENT.format(kind))
    return c.materialize(rows, "positions", compression="none")


class Segment:
    """A row of the index, read: words, and the places of each in one ascending array."""

    def __init__(self, row: dict):
        size = int.from_bytes(row["letters"][:8], "little")
        letters = np.frombuffer(pa.decompress(row["letters"][8:], size, "zstd", asbytes=True), np.uint8)
        sizes = _unpacked(row["letter_sizes"])
        upto = np.cumsum(sizes)
        hashes = np.frombuffer(row["moved"], "<u8") if row["moved"] else c.hash_ranges(c.padded(letters), upto - sizes, sizes)
        self.words = Dictionary(hashes, letters, upto)
        self.ends = np.cumsum(_unpacked(row["counts"]))
        self.begins = np.concatenate([[0], self.ends[:-1]])[: len(self.ends)]
        if "postings" in row:
            self.first = np.cumsum(_unpacked(row["first"]))
            self.base = self.first[:-1] + np.arange(len(self.first) - 1)
            step = _unpacked(row["postings"])
            upto = np.cumsum(step)
            before = np.concatenate([[0], upto])[self.begins]
            self.places = upto - np.repeat(before, self.ends - self.begins)
            #: (entry, place) as one ascending number
            self.spots = (np.repeat(np.arange(len(self.ends)), self.ends - self.begins) << 32) | self.places

    def rows(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, places, "right") - 1

    def holds(self, entry: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a place is in an entry's list."""
        wanted = (entry << 32) | place
        spot = np.minimum(np.searchsorted(self.spots, wanted), len(self.spots) - 1)
        return (place >= 0) & (self.spots[spot] == wanted)


# --- phrases -------------------------------------------------------------------------------------


class Phrases:
    """The distinct windows of a slice of items, as numbers of distinct words."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        low, starts, sizes, hashes, first = lower_words(pa.array([t for _, t in items], pa.string()))
        self.words, order, ends = dictionary(low, starts, sizes, hashes)
        number = np.empty(len(order), np.int32)
        number[order] = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        self.items = sorted({str(i) for i, _ in items})
        rank = {x: i for i, x in enumerate(self.items)}
        windows: dict[bytes, set[int]] = {}
        for (item, _), a, b in zip(items, first.tolist(), first[1:].tolist()):
            n = min(size, b - a)
            for i in range(a, b - n + 1 if n else a):
                windows.setdefault(number[i : i + n].tobytes(), set()).add(rank[str(item)])
        self.sizes = np.array([len(w) // 4 for w in windows], np.int64)
        self.terms = np.full((len(windows), max([1, *self.sizes.tolist()])), -1, np.int32)
        for i, w in enumerate(windows):
            self.terms[i, : self.sizes[i]] = np.frombuffer(w, np.int32)
        lists = [sorted(x) for x in windows.values()]
        self.owner_ends = np.cumsum([len(x) for x in lists])
        self.owners = np.array([y for x in lists for y in x], np.int64)
        self.order = np.zeros_like(self.terms)

    def by_frequency(self, frequency: np.ndarray) -> None:
        """From each window's rarest term to its most frequent one."""
        count = np.where(self.terms >= 0, frequency[self.terms], np.iinfo(np.int64).max) if len(frequency) else np.zeros(self.terms.shape)
        self.order = np.argsort(count, axis=1, kind="stable").astype(np.int32)

    def entries(self, segment: Segment) -> np.ndarray:
        """The segment's entry of each of our words, -1 if it has none."""
        w = self.words
        return segment.words.find(w.hashes, c.padded(w.letters), w.starts, w.ends - w.starts)

    def matches(self, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """(window, place of its first word) of every exact match."""
        none = np.zeros(0, np.int64)
        if not len(self.terms) or not len(segment.ends):
            return none, none
        entry = self.entries(segment)
        has = np.where(self.terms >= 0, entry[self.terms] >= 0, True).all(axis=1)
        alive = np.flatnonzero(has)
        if not len(alive):
            return none, none
        off = self.order[alive, 0]
        rarest = entry[self.terms[alive, off]]
        counts = segment.ends[rarest] - segment.begins[rarest]
        found_window, found_place = [], []
        cuts = np.searchsorted(np.cumsum(counts), np.arange(0, int(counts.sum()) + PLACES, PLACES), "right")
        for a, b in zip([0, *cuts[1:-1].tolist()], [*cuts[1:-1].tolist(), len(alive)]):
            if b <= a:
                continue
            n = counts[a:b]
            upto = np.cumsum(n)
            places = segment.places[np.repeat(segment.begins[rarest[a:b]] - upto + n, n) + np.arange(upto[-1])] - np.repeat(off[a:b], n)
            window = np.repeat(alive[a:b], n)
            for turn in range(1, self.terms.shape[1]):
                at = self.order[window, turn]
                term = self.terms[window, at]
                asked = np.flatnonzero(term >= 0)
                good = np.ones(len(window), bool)
                good[asked] = segment.holds(entry[term[asked]], places[asked] + at[asked])
                window, places = window[good], places[good]
                if not len(window):
                    break
            good = places >= 0
            found_window.append(window[good])
            found_place.append(places[good])
        return np.concatenate(found_window), np.concatenate(found_place)


def _sliced(benchmark: DataFrame, words: int) -> Iterator[list[tuple[object, str | None]]]:
    """Slices of the items, streamed to the driver; each has about `words` words or one item."""
    held, size = [], 0
    for row in benchmark.select("item_id", "text").distinct().toLocalIterator():
        n = len(row["text"] or "") // 4
        if held and size + n > words:
            yield held
            held, size = [], 0
        held.append((row["item_id"], row["text"]))
        size += n
    if held:
        yield held


def term_frequencies(index: DataFrame, phrases: Phrases) -> np.ndarray:
    """Occurrences of each of the phrases' words in all documents: sums over the segments' dictionaries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(phrases.words.hashes), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment({x: batch.column(x)[i].as_py() for x in _WORDS})
                entry = phrases.entries(segment)
                here = entry >= 0
                total[here] += (segment.ends - segment.begins)[entry[here]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(len(phrases.words.hashes), np.int64)
    counted = index.select(*_WORDS).mapInArrow(c.tidy(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    return out


_SPANS = "array<struct<start:int,end:int>>"


def _lookup(index: DataFrame, phrases: Phrases) -> DataFrame:
    """segment, row, doc, n_words, spans and items of every document of the index."""
    kind = dict(index.dtypes)["keys"][6:-1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(phrases.items, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment({x: batch.column(x)[i].as_py() for x in (*_WORDS, *_PLACES)})
                n = len(segment.base)
                window, place = phrases.matches(segment)
                of = segment.rows(place)
                start = place - segment.base[of]
                end = start + phrases.sizes[window]
                order = np.lexsort((start, of))
                of_sorted, start, end = of[order], start[order], end[order]
                # spans that overlap or touch become one; a row's ends never reach into the next row's numbers
                reach = np.maximum.accumulate((of_sorted << 32) + end) if len(end) else end
                new = np.ones(len(order), bool)
                new[1:] = ((of_sorted[1:] << 32) + start[1:]) > reach[:-1]
                last = np.append(np.flatnonzero(new)[1:] - 1, len(order) - 1)[: int(new.sum())]
                spans = pa.StructArray.from_arrays([pa.array(start[new].astype(np.int32)), pa.array((reach[last] & 0xFFFFFFFF).astype(np.int32))], ["start", "end"])
                span_ends = np.searchsorted(of_sorted[new], np.arange(n + 1))
                lens = np.diff(np.concatenate([[0], phrases.owner_ends]))[window] if len(window) else np.zeros(0, np.int64)
                upto = np.cumsum(lens)
                owner = phrases.owners[np.repeat(phrases.owner_ends[window] - upto, lens) + np.arange(upto[-1])] if len(window) else lens
                pair = np.unique((np.repeat(of, lens) << 32) | owner)
                item_ends = np.searchsorted(pair >> 32, np.arange(n + 1))
                columns = [
                    pa.array(np.full(n, batch.column("segment")[i].as_py(), np.int64)),
                    pa.array(np.arange(n, dtype=np.int32)),
                    batch.column("keys")[i].values,
                    pa.array(np.diff(segment.first)),
                    pa.ListArray.from_arrays(pa.array(span_ends.astype(np.int32)), spans),
                    pa.ListArray.from_arrays(pa.array(item_ends.astype(np.int32)), names.take(pa.array(pair & 0xFFFFFFFF))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "row", "doc", "n_words", "spans", "items"])

    return index.mapInArrow(c.tidy(find), f"segment long, row int, doc {kind}, n_words long, spans {_SPANS}, items array<string>")


def hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, key: str = "doc_id", index: DataFrame | None = None) -> DataFrame:
    """key, n_words, spans (array of [start, end) in words, apart from each other) and items (sorted ids as text), a row for each row of docs.

    index: that of positional_index(docs, key), if it is there already.
    """
    spark = c.prepare(docs.sparkSession)
    index = positional_index(docs, key) if index is None else index
    parts = []
    for items in _sliced(benchmark, SLICE_WORDS):
        phrases = Phrases(items, size)
        if len(phrases.terms):
            phrases.by_frequency(term_frequencies(index, phrases))
            parts.append(_lookup(index, phrases))
    if len(parts) < 2:
        found = parts[0] if parts else _lookup(index, Phrases([], size))
        return found.select(F.col("doc").alias(key), "n_words", "spans", "items")
    parts = [c.materialize(p.where("size(spans) > 0") if i else p, "phrase-hits") for i, p in enumerate(parts)]
    rows = parts[0].where("size(spans) > 0")
    for p in parts[1:]:
        rows = rows.unionByName(p)
    both = rows.groupBy("segment", "row").agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    both = c.materialize(both.select("segment", "row", _merged(F.col("s")).alias("s"), F.array_sort(F.array_distinct("i")).alias("i")), "hits")
    every = parts[0].join(c.small(both), ["segment", "row"], "left")
    return every.select(F.col("doc").alias(key), "n_words", F.coalesce("s", "spans").alias("spans"), F.coalesce("i", "items").alias("items"))


def _merged(spans):
    """Spans in order, those that overlap or touch as one."""
    start = F.expr(f"cast(array() as {_SPANS})")

    def add(acc, x):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), grown).otherwise(F.concat(acc, F.array(x))).cast(_SPANS)

    return F.aggregate(F.array_sort(spans), start, add)


def proximity_matches(docs: DataFrame, terms: list[str], within: int, key: str = "doc_id", index: DataFrame | None = None) -> DataFrame:
    """key, start, end: the least spans of at most `within` words that hold all the terms in any order."""
    c.prepare(docs.sparkSession)
    index = positional_index(docs, key) if index is None else index
    kind = dict(index.dtypes)["keys"][6:-1]
    phrases = Phrases([(0, " ".join(terms))], 1)
    n_terms = len(phrases.words.hashes)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment({x: batch.column(x)[i].as_py() for x in (*_WORDS, *_PLACES)})
                entry = phrases.entries(segment)
                if not n_terms or (entry < 0).any():
                    continue
                lists = [segment.places[segment.begins[e] : segment.ends[e]] for e in entry.tolist()]
                # rows that hold every term, from the rarest on
                rows = np.unique(segment.rows(min(lists, key=len)))
                for x in sorted(lists, key=len)[1:]:
                    rows = np.intersect1d(rows, segment.rows(x))
                lists = [x[np.isin(segment.rows(x), rows)] for x in lists]
                place = np.concatenate(lists)
                term = np.repeat(np.arange(n_terms), [len(x) for x in lists])
                order = np.argsort(place)
                out: list[tuple[int, int, int]] = []
                row, last = -1, {}
                for p, t, r in zip(place[order].tolist(), term[order].tolist(), segment.rows(place[order]).tolist()):
                    if r != row:
                        row, last = r, {}
                    last[t] = p
                    low = min(last.values())
                    if len(last) == n_terms and p - low < within and not (out and out[-1][:2] == (r, low)):
                        out.append((r, low, p + 1))
                got = np.array(out, np.int64).reshape(-1, 3)
                base = segment.base[got[:, 0]]
                keys = batch.column("keys")[i].values.take(pa.array(got[:, 0]))
                yield pa.RecordBatch.from_arrays([keys, pa.array((got[:, 1] - base).astype(np.int32)), pa.array((got[:, 2] - base).astype(np.int32))], ["doc", "start", "end"])

    return index.mapInArrow(c.tidy(sweep), f"doc {kind}, start int, end int").withColumnRenamed("doc", key)


# --- verdicts ------------------------------------------------------------------------------------


def judged(found: DataFrame) -> DataFrame:
    """hits() with n_hit, n_items and contaminated: hit words make a twentieth of all at least."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text isn't contaminated; the text is told by two hashes of it."""
    key = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    found = judged(hits(docs.select(key.alias("text_key"), "text"), benchmark, key="text_key"))
    bad = c.materialize(found.where("contaminated").select(F.col("text_key.h1").alias("_h1"), F.col("text_key.h2").alias("_h2")).distinct(), "contaminated")
    return docs.join(c.small(bad), (F.xxhash64(docs["text"]) == F.col("_h1")) & (F.xxhash64(F.lit(1), docs["text"]) == F.col("_h2")), "left_anti")


#: What digest() gives for a document without hits.
NO_ITEMS = hashlib.sha256(b"").hexdigest()
