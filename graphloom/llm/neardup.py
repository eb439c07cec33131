"""Near-duplicate detection with SetSketch registers.

A document is its set of distinct word shingles. Register i of its sketch is
K_i = clip(floor(1 - log_b x_i), 0, q + 1), with x_i the least of the exponential hash values
that the shingles have under hash i: exponentially spaced, truncated minima. The sketch of a
union is the larger of each register (merge()), so a long text's sketch is merged from its
pieces. Equal registers are likelier the more alike two sets are, so documents are put into
buckets by bands of registers. Of a pair that shares a bucket the similarity is estimated jointly
by likelihood from the counts of larger, equal and smaller registers (with the set sizes known);
every pair that the estimate doesn't rule out is verified on full sets.

Steps, and what keeps each bounded whatever the skew:
1. a sketch for each document, from its whole text, in one pass;
2. equal sets collapse into a class by grouping on two set hashes and the size, so a third of all
   rows being copies costs a partial aggregation; from here on a class has a number of its own,
   so doc_ids may repeat with different texts;
3. the smallest class of a bucket leads it. Members meet their leaders only: a pair each, estimated
   from registers, then verified in groups of one leader and a block of its members;
4. buckets whose other members are still of two components or more are dealt into blocks, bounded in
   documents and in shingles. Blocks of the leader's component (M) meet blocks of all others (U), and
   U meets U, but M never meets M. Registers go first and name the documents that have a partner
   left; only these send their sets, and a task emits at most one link per document it holds (a
   spanning forest of the verified pairs), never all pairs;
5. components of the links by distributed contraction.

With rows per band and bands as in `bands()`, a pair at the threshold shares no bucket with
a probability under one in a million; the estimate rules out pairs more than five standard
deviations below the threshold only, in groups of every size alike. Shingles are compared by hashes
of 64 bits: two of the shingles of a pair of documents are mistaken for one another with a
probability of under n * n / 2^64.

Defined cases: null or empty texts, or texts of white space, have no set, link with nothing and
are kept; a text with fewer words than a shingle is one shingle of all its words; repeated
rows are copies; rows of one doc_id with different texts are judged each by its own text, and a
row's component is the smallest doc_id of the rows it reaches; rows without doc_id link with
nothing, have a null component and are kept; an empty table gives an empty result; columns
of other names are not read by near_duplicates() and stay in deduplicate().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

BASE = 1.02
RATE = 20.0
TOP = 4095
#: Shingles of a piece of a long document.
PIECE = 1 << 16
#: Shingles and documents in a block: what bounds a task's memory and its comparisons.
BLOCK_SHINGLES = 200_000
BLOCK_DOCS = 256
MISS = 1e-6


def bands(similarity: float, rows: int | None = None) -> tuple[int, int]:
    """(registers per band, bands) so that a pair at the similarity is missed with probability MISS at most."""
    rows = rows or (6 if similarity >= 0.84 else 5)
    return rows, math.ceil(math.log(MISS) / math.log(1 - similarity**rows))


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    raw = c.mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return (raw[:m] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (raw[m:] >> np.uint64(32)).astype(np.uint32)


_LOG = math.log(BASE)


def registers(shingles: np.ndarray, m: int) -> np.ndarray:
    """The m registers of a set of 64-bit shingle hashes, merged from pieces of the set."""
    odd, shift = _seeds(m)
    half = ((shingles >> np.uint64(32)) ^ (shingles & np.uint64(0xFFFFFFFF)) * np.uint64(3)).astype(np.uint32)
    low = np.full(m, 0xFFFFFFFF, np.uint32)
    out = np.zeros(m, np.uint16)
    for at in range(0, len(half), 512):
        part = half[at : at + 512, None] ^ shift
        part *= odd
        part ^= part >> np.uint32(15)
        np.minimum(low, part.min(axis=0), out=low)
        if at % PIECE == PIECE - 512:
            out, low = merge(out, _register(low)), np.full(m, 0xFFFFFFFF, np.uint32)
    return merge(out, _register(low))


def _register(low: np.ndarray) -> np.ndarray:
    """Registers of the least 32-bit hash values."""
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / _LOG), 0, TOP).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(one, other)


def _power_of(x: np.ndarray) -> np.ndarray:
    """p_b(x) of the joint estimate: the probability that one register is larger, for a share x of own elements."""
    return -np.log1p(-x * (BASE - 1) / BASE) / _LOG


def slope(larger: np.ndarray, equal: np.ndarray, smaller: np.ndarray, n_u: np.ndarray, n_v: np.ndarray, at: float) -> np.ndarray:
    """Derivative of the joint log-likelihood of a similarity `at`; the estimate is at least `at` if it isn't negative.

    larger, equal, smaller: registers of U above, equal to and below those of V, whose sizes are n_u and n_v.
    """
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    step = 1e-3
    total = []
    for j in (at - step, at + step):
        up = _power_of(np.maximum(u - v * j, 1e-9))
        down = _power_of(np.maximum(v - u * j, 1e-9))
        total.append(larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12)))
    return total[1] - total[0]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = c.utf8(texts)
    hashes, first = c.words(data, offsets)
    for a, b in zip(first.tolist(), first[1:].tolist()):
        yield np.unique(c.windows(hashes[a:b], k))


def set_hashes(own: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    return int(c.mix(own).sum(dtype=np.uint64).view(np.int64)), int(c.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def sketches(docs: DataFrame, k: int, similarity: float) -> DataFrame:
    """doc_id, n, h1, h2 (hashes of the set) and regs (registers of 16 bits); n = 0: no set, no registers."""
    rows, n_bands = bands(similarity)
    m = rows * n_bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                n, h1, h2, regs = [], [], [], []
                for own in shingle_sets(some.column("text"), k):
                    n.append(len(own))
                    one, two = set_hashes(own) if len(own) else (0, 0)
                    h1.append(one), h2.append(two)
                    regs.append(registers(own, m).tobytes() if len(own) else None)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n", "h1", "h2", "regs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(c.tidy(run), "doc_id long, n long, h1 long, h2 long, regs binary")


def bucket_keys(sketched: DataFrame, rows: int, n_bands: int) -> DataFrame:
    """cid, key: a bucket of each band. Slices of the registers' bytes are hashed in the JVM."""
    band = lambda i: F.xxhash64(F.col("regs").substr(i * F.lit(2 * rows) + 1, F.lit(2 * rows)), i)
    keys = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), band)
    return sketched.select("cid", F.explode(keys).alias("key"))


class _Forest:
    """Union-find over the documents of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _sieve(regs: np.ndarray, sizes: np.ndarray, i: int, near: np.ndarray, cut: float) -> np.ndarray:
    """Those of `near` whose estimated similarity to document i isn't below cut."""
    larger, smaller = (regs[i] > regs[near]).sum(1), (regs[i] < regs[near]).sum(1)
    return near[slope(larger, regs.shape[1] - larger - smaller, smaller, float(sizes[i]), sizes[near].astype(float), cut) >= 0]


def cut_of(percent: int, m: int) -> float:
    """Five standard deviations of the share of equal registers below the threshold."""
    s = percent / 100
    return s - 5 * math.sqrt(s * (1 - s) / m)


def _partners(sizes: np.ndarray, side: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each document, in ascending sizes, with those behind it of a size that allows a link, of the other side if there are two."""
    two = len(np.unique(side)) > 1
    for i in range(len(sizes) - 1):
        near = np.arange(i + 1, int(np.searchsorted(sizes, sizes[i] * 100 // percent, "right")))
        if two:
            near = near[side[near] != side[i]]
        if len(near):
            yield i, near


def promising(sizes: np.ndarray, regs: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Which documents have a partner of another component that the estimate doesn't rule out."""
    order = np.argsort(sizes, kind="stable")
    sizes, regs, comp, side = sizes[order], regs[order], comp[order], side[order]
    cut, good = cut_of(percent, regs.shape[1]), np.zeros(len(sizes), bool)
    for i, near in _partners(sizes, side, percent):
        near = near[comp[near] != comp[i]]
        if good[i]:  # only those not yet named are of interest
            near = near[~good[near]]
        found = _sieve(regs, sizes, i, near, cut) if len(near) else near
        if len(found):
            good[i] = good[found] = True
    out = np.zeros(len(sizes), bool)
    out[order] = good
    return out


def forest_of_links(ids: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, comp: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the components as do all pairs with 100 * |A and B| >= percent * |A or B|.

    comp: components known to be joined. side: 0 or 1, of two blocks; one block alone has all its pairs compared.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    ids, sets, sizes, regs, comp, side = ids[order], [sets[i] for i in order], sizes[order], regs[order], comp[order], side[order]
    cut = cut_of(percent, regs.shape[1])
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    value, number = np.unique(flat, return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    has = np.zeros(len(value), bool)
    forest, links, seen = _Forest(n), [], {}
    for i, x in enumerate(comp.tolist()):
        forest.join(seen.setdefault(x, i), i)
    for i, near in _partners(sizes, side, percent):
        root = forest.find(i)
        near = near[[forest.find(j) != root for j in near.tolist()]]
        near = _sieve(regs, sizes, i, near, cut) if len(near) else near
        if not len(near):
            continue
        own = number[first[i] : first[i + 1]]
        has[own] = True
        for some in (near[x : x + 64] for x in range(0, len(near), 64)):
            lens = sizes[some]
            upto = np.cumsum(lens)
            both = np.add.reduceat(has[number[np.repeat(first[some] - upto + lens, lens) + np.arange(upto[-1])]], upto - lens, dtype=np.int64)
            for j in some[100 * both >= percent * (sizes[i] + lens - both)].tolist():
                if forest.join(i, j):
                    links.append((int(ids[i]), int(ids[j])))
        has[own] = False
    return links


_LINKS = "a long, b long"


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b, na, nb, ra, rb) that the estimate from registers doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                one, two = (np.frombuffer(b"".join(some.column(x).to_pylist()), np.uint16).reshape(some.num_rows, -1) for x in ("ra", "rb"))
                na, nb = (some.column(x).to_numpy().astype(float) for x in ("na", "nb"))
                larger, smaller = (one > two).sum(1), (one < two).sum(1)
                good = slope(larger, one.shape[1] - larger - smaller, smaller, na, nb, cut_of(percent, one.shape[1])) >= 0
                yield some.select(["a", "b"]).filter(pa.array(good))

    return pairs.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(c.tidy(run), _LINKS)


def _sets(docs: DataFrame, wanted: DataFrame, k: int, payload: str) -> DataFrame:
    """cid, the payload and shingles (binary) of each class in wanted(cid, doc_id, n, h1, h2, spots); spots: an array of the payload's structs.

    A row of docs gives a set only if its text has that of the class; repeated rows give it once a task.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(c.small(wanted), "doc_id").select("text", "cid", "n", "h1", "h2", "spots")
    spots = dict(wanted.dtypes)["spots"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                cid, n, h1, h2 = (some.column(x).to_pylist() for x in ("cid", "n", "h1", "h2"))
                rows, sets = [], []
                for i, s in enumerate(shingle_sets(some.column("text"), k)):
                    if cid[i] not in done and len(s) == n[i] and set_hashes(s) == (h1[i], h2[i]):
                        done.add(cid[i])
                        rows.append(i)
                        sets.append(s.tobytes())
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("cid").take(take), some.column("spots").take(take), pa.array(sets, pa.binary())], ["cid", "spots", "shingles"])

    rows = own.mapInArrow(c.tidy(cut), f"cid long, spots {spots}, shingles binary")
    return rows.select("cid", "shingles", F.explode("spots").alias("p")).select("cid", "shingles", *[F.col(f"p.{x}").alias(x) for x in payload.split()])


def verified_with_leaders(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a: leader, b) that hold on full sets: groups of one leader and a block of its members."""
    size = classes.select("cid", "n")
    sized = c.materialize(pairs.join(size.withColumnRenamed("cid", "b"), "b").select("a", "b", "n"), "leader-pairs")
    blocks = sized.groupBy("a").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).cast("int").alias("blocks"))
    blocks = c.materialize(blocks, "leader-blocks")
    key = lambda block: F.xxhash64("a", block).alias("key")
    led = blocks.select(F.col("a").alias("cid"), F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(key(i), F.lit(0).alias("side")))).alias("spot"))
    block = F.pmod(F.xxhash64("b"), F.col("blocks"))
    member = sized.join(c.small(blocks), "a").select(F.col("b").alias("cid"), F.struct(key(block.cast("int")), F.lit(1).alias("side")).alias("spot"))
    spots = led.unionByName(member).groupBy("cid").agg(F.collect_list("spot").alias("spots"))
    rows = _sets(docs, c.materialize(spots.join(classes.select("cid", F.col("rep").alias("doc_id"), "n", "h1", "h2"), "cid"), "leader-spots"), k, "key side")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in c.arrow_groups(batches, "key"):
            ids, side, cells = group.column("cid").to_pylist(), group.column("side").to_pylist(), group.column("shingles")
            leaders = {ids[i]: np.frombuffer(cells[i].as_py(), np.uint64) for i, s in enumerate(side) if not s}
            for lead, own in leaders.items():  # one, but for keys that collide
                for i in dict(zip(ids, range(len(ids)))).values():
                    if side[i]:
                        other = np.frombuffer(cells[i].as_py(), np.uint64)
                        spot = np.minimum(np.searchsorted(own, other), len(own) - 1)
                        both = int((own[spot] == other).sum())
                        if 100 * both >= percent * (len(own) + len(other) - both):
                            out.append((lead, ids[i]))
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(c.tidy(check), _LINKS)


def _dealt(members: DataFrame, by_docs: int, by_shingles: int) -> DataFrame:
    """cid, comp, n, with spots: the group keys and sides that each member(key, cid, comp, n, main) of a bucket goes to.

    A bucket within one block is one group. Else U blocks (main false) meet each other and the M blocks; M never meets M.
    """
    parts = lambda some: F.greatest(F.lit(1), F.ceil(F.sum(F.when(some, 1)) / by_docs), F.ceil(F.sum(F.when(some, F.col("n"))) / by_shingles)).cast("int")
    total = members.groupBy("key").agg(parts(F.lit(True)).alias("all"), parts(~F.col("main")).alias("u"), parts(F.col("main")).alias("m"))
    large = c.materialize(total.where("all > 1"), "large-buckets")
    placed = members.join(c.small(large), "key", "left")
    salt = lambda blocks: F.pmod(F.xxhash64("cid"), blocks).cast("int")
    own = F.when(F.col("main"), F.col("u") + salt(F.col("m"))).otherwise(salt(F.col("u")))
    placed = placed.withColumn("own", own)
    meets = F.when(F.col("main"), F.sequence(F.lit(0), F.col("u") - 1)).otherwise(F.sequence(F.lit(0), F.col("u") + F.col("m") - 1))
    spot = lambda j: F.struct(F.xxhash64("key", F.least("own", j), F.greatest("own", j)).alias("key"), F.when(F.col("own") <= j, 0).otherwise(1).alias("side"))
    alone = F.array(F.struct(F.xxhash64("key", F.lit(0), F.lit(0)).alias("key"), F.lit(0).alias("side")))
    return placed.select("key", "cid", "comp", "n", F.when(F.col("all").isNull(), alone).otherwise(F.transform(meets, spot)).alias("spots"))


def unresolved_links(docs: DataFrame, classes: DataFrame, buckets: DataFrame, leaders: DataFrame, joined: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links between members of one bucket that the leaders left in different components (joined: node, component)."""
    comp = lambda name, out: joined.select(F.col("node").alias(name), F.col("component").alias(out))
    inside = buckets.join(leaders, "key")
    inside = inside.join(comp("cid", "c1"), "cid", "left").join(comp("lead", "c2"), "lead", "left")
    inside = inside.select("key", "cid", "lead", F.coalesce("c1", "cid").alias("comp"), F.coalesce("c2", "lead").alias("lead_comp"))
    inside = c.materialize(inside, "bucket-members")
    # leaders have met everyone of their buckets; without them two components must be left
    rest = inside.where("cid <> lead")
    open_keys = rest.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    rest = rest.join(c.small(c.materialize(open_keys, "open-buckets")), "key", "left_semi")
    facts = classes.select("cid", "n", "regs")
    rest = c.materialize(rest.join(facts.select("cid", "n"), "cid").select("key", "cid", "comp", "n", (F.col("comp") == F.col("lead_comp")).alias("main")), "open-members")
    if rest.isEmpty():
        return docs.sparkSession.createDataFrame([], _LINKS)

    met = _dealt(rest, BLOCK_DOCS, 1 << 62).join(facts.select("cid", "regs"), "cid")
    met = met.select("key", "cid", "comp", "n", "regs", F.explode("spots").alias("p")).select("key", "cid", "comp", "n", "regs", F.col("p.key").alias("meet"), F.col("p.side").alias("side"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in c.arrow_groups(batches, "meet"):
            if group.num_rows < 2:
                continue
            regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(group.num_rows, -1)
            good = promising(group.column("n").to_numpy(), regs, group.column("comp").to_numpy(), group.column("side").to_numpy(), percent)
            if good.any():
                yield from group.select(["key", "cid"]).filter(pa.array(good)).to_batches()

    named = met.repartition("meet").sortWithinPartitions("meet").mapInArrow(c.tidy(sift), "key long, cid long")
    named = c.materialize(named.distinct(), "named")
    if named.isEmpty():
        return docs.sparkSession.createDataFrame([], _LINKS)
    dealt = _dealt(rest.join(c.small(named), ["key", "cid"], "left_semi"), BLOCK_DOCS, BLOCK_SHINGLES)
    spots = dealt.groupBy("cid").agg(F.min("comp").alias("comp"), F.flatten(F.collect_list("spots")).alias("spots"))
    spots = spots.select("cid", F.transform("spots", lambda p: F.struct(p["key"].alias("key"), p["side"].alias("side"), F.col("comp").alias("comp"))).alias("spots"))
    rows = _sets(docs, c.materialize(spots.join(classes.select("cid", F.col("rep").alias("doc_id"), "n", "h1", "h2"), "cid"), "open-spots"), k, "key side comp")
    rows_of, n_bands = bands(percent / 100)
    m = rows_of * n_bands

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in c.arrow_groups(batches, "key"):
            ids = group.column("cid").to_numpy()
            keep = np.unique(ids, return_index=True)[1]
            if len(keep) < 2:
                continue
            cells = group.column("shingles")
            sets = [np.frombuffer(cells[i].as_py(), np.uint64) for i in keep.tolist()]
            regs = np.stack([registers(s, m) for s in sets])
            out += forest_of_links(ids[keep], sets, regs, group.column("comp").to_numpy()[keep], group.column("side").to_numpy()[keep], percent)
            if len(out) > 50_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(c.tidy(join), _LINKS)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included), kept."""
    c.prepare(docs.sparkSession)
    rows, n_bands = bands(percent / 100)
    sig = c.materialize(sketches(docs, k, percent / 100), "sketches")
    real = sig.where("n > 0 and doc_id is not null")
    # the number of a class is fixed as it is written
    classes = real.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("regs").alias("regs"))
    classes = c.materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    buckets = bucket_keys(classes, rows, n_bands)
    leaders = c.materialize(buckets.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last")).where("lead < last").select("key", "lead"), "leaders")
    buckets = c.materialize(buckets.join(leaders, "key", "left_semi"), "buckets")
    ties = buckets.join(leaders, "key").where("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()
    facts = classes.select("cid", "n", "regs")
    ties = ties.join(facts.toDF("a", "na", "ra"), "a").join(facts.toDF("b", "nb", "rb"), "b")
    ties = c.materialize(likely(ties, percent), "likely")
    links = c.materialize(verified_with_leaders(docs, classes, ties, k, percent), "links")
    joined = c.materialize(c.components(links), "joined")
    more = c.materialize(unresolved_links(docs, classes, buckets, leaders, joined, k, percent), "more-links")
    if not more.isEmpty():
        joined = c.components(links.unionByName(more))
    grouped = classes.select("cid", "h1", "h2", "n", "rep").join(joined.select(F.col("node").alias("cid"), "component"), "cid", "left")
    grouped = c.materialize(grouped.select("h1", "h2", "n", "rep", F.coalesce("component", "cid").alias("component")), "grouped")
    least = c.materialize(grouped.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = grouped.join(least, "component").select("h1", "h2", "n", "component_id")
    whole = real.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"]).select("doc_id", "n", "component_id")
    alone = sig.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    every = whole.unionByName(alone)
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose document is kept: one of each group, the one with the smallest doc_id.

    Repeated rows of a kept doc_id collapse to one. Of a doc_id with different texts all rows stay or go
    together: they go if each of them has a smaller doc_id in its group.
    """
    names = docs.columns
    found = c.materialize(near_duplicates(docs.select("doc_id", "text"), k, percent).where("doc_id is not null"), "judged")
    of_id = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    gone = c.materialize(of_id.where("not kept").select(F.col("doc_id").alias("_gone")), "gone")
    again = c.materialize(of_id.where("kept and n > 1").select(F.col("doc_id").alias("_again")), "again")
    left = docs.join(c.small(gone), docs["doc_id"] == F.col("_gone"), "left_anti")
    if again.isEmpty():
        return left
    once = left.join(c.small(again), left["doc_id"] == F.col("_again"), "left_semi").dropDuplicates(["doc_id"])
    return left.join(c.small(again), left["doc_id"] == F.col("_again"), "left_anti").unionByName(once).select(*[F.col(f"`{x}`") for x in names])
