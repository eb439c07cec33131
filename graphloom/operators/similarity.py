"""Name and vector similarity: built-in expressions, and an Arrow function for Jaro-Winkler, which Spark lacks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import counted, importable

#: Names of a watch list that are broadcast.
LISTED = 20_000


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if lengths differ or a norm is 0."""
    d = lambda x: F.transform(x, lambda y: y.cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y)
    dot = total(F.zip_with(d(a), d(b), lambda x, y: x * y))
    norm = lambda v: F.sqrt(total(F.transform(d(v), lambda x: x * x)))
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def normalize_name(name: Column) -> Column:
    """Lower case, letters and digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""), r"\s+", " "))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaro_winkler_of(a: str, b: str) -> float:
    """Matches within half the longer length, half the transpositions, and a bonus for up to four equal first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, picked = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                picked.append(x)
                break
    if not picked:
        return 0.0
    other = [y for y, u in zip(b, used) if u]
    m, swapped = len(picked), sum(x != y for x, y in zip(picked, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b):
        if None in pair:
            out.append(None)
            continue
        if pair not in known:
            known[pair] = jaro_winkler_of(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


#: The code of each consonant; others have none.
SOUND_CODES = {"bfpv": "1", "cgjkqsxz": "2", "dt": "3", "l": "4", "mn": "5", "r": "6"}


def sound_code(name: Column) -> Column:
    """First letter and the codes of the rest, repeats of a code as one (across vowels, too), padded to four."""
    letters = F.regexp_replace(F.lower(name), "[^a-z]", "")
    coded = F.translate(letters, "".join(SOUND_CODES), "".join(v * len(k) for k, v in SOUND_CODES.items()))
    codes = F.regexp_replace(coded, "[^1-6]", "")
    codes = F.regexp_replace(codes, r"(\d)\1+", "$1")
    return F.when(letters == "", "").otherwise(F.substring(F.concat(F.upper(F.substring(letters, 1, 1)), codes, F.lit("000")), 1, 4))


#: Vectors of a block: two blocks meet in a task.
BLOCK = 2048


def similar_pairs(vectors: DataFrame, at_least: float) -> DataFrame:
    """a, b, cosine of all pairs a < b of distinct ids that are at least that alike, over the whole table.

    Vectors are dealt into blocks by id; each pair of blocks is one product of two bounded matrices, and
    only pairs that are alike leave it. Vectors of other lengths than the first of their block's, or of norm 0, have cosine 0.
    """
    rows, n = counted(vectors.where("id is not null and vec is not null").select("id", F.col("vec").cast("array<double>").alias("vec")))
    importable(vectors.sparkSession)
    blocks = max(1, -(-n // BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    meets = rows.withColumn("own", own).select("id", "vec", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    dealt = meets.select((F.least("own", "other") * blocks + F.greatest("own", "other")).alias("key"), (F.col("own") > F.col("other")).alias("side"), (F.col("own") == F.col("other")).alias("alone"), "id", "vec")

    def unit(vecs: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        lens = vecs.map(len).to_numpy()
        out = {}
        for size in np.unique(lens):
            spots = np.flatnonzero(lens == size)
            x = np.stack(vecs.iloc[spots].to_list()) if size else np.zeros((len(spots), 0))
            norm = np.sqrt((x * x).sum(1, keepdims=True))
            out[int(size)] = spots, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        return out

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        alone = bool(group["alone"].iloc[0])
        left = group if alone else group[~group["side"]]
        right = group if alone else group[group["side"]]
        one, two = unit(left["vec"]), unit(right["vec"])
        a_ids, b_ids = left["id"].to_numpy(), right["id"].to_numpy()
        score = np.zeros((len(left), len(right)))
        for size, (spots, x) in one.items():
            if size in two:
                others, y = two[size]
                score[np.ix_(spots, others)] = x @ y.T
        i, j = np.nonzero(score >= at_least)
        a, b = a_ids[i], b_ids[j]
        keep = a < b if alone else a != b
        a, b, s = a[keep], b[keep], score[i, j][keep]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": s})

    return dealt.groupBy("key").applyInPandas(compare, f"a {dict(rows.dtypes)['id']}, b {dict(rows.dtypes)['id']}, cosine double")


def token_similarity(a: Column, b: Column) -> Column:
    """Share of the words of the longer name that the other has."""
    one, two = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.size(F.array_intersect(one, two)) / F.greatest(F.size(one), F.size(two)).cast("double")


def sound_similarity(a: Column, b: Column) -> Column:
    return F.when((sound_code(a) == sound_code(b)) & (sound_code(a) != ""), 0.85).otherwise(0.0)


#: Ways to compare two normal names, the best of which counts.
WAYS = {"edit": levenshtein_similarity, "letters": jaro_winkler, "words": token_similarity, "sound": sound_similarity}


def fuzzy_matches(names: DataFrame, listed: DataFrame, at_least: float, ways: dict | None = None) -> DataFrame:
    """name, listed, score: the best of the ways (edit distance, common letters, words, sound code) of each name and each of a watch list.

    Normal forms are compared, each pair once. A side of a counted size is broadcast; a larger one is dealt by
    blocks of its names, so that each pair of blocks is one task's work.
    """
    left, n = counted(names.select(normalize_name(F.col("name")).alias("name")).where("name <> ''").distinct())
    right, m = counted(listed.select(normalize_name(F.col(listed.columns[0])).alias("listed")).where("listed <> ''").distinct())
    blocks = max(1, -(-m // LISTED))
    if blocks == 1:
        pairs = left.join(F.broadcast(right), F.lit(True))
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
        pairs = left.select("name", every).join(right.withColumn("block", F.pmod(F.xxhash64("listed"), F.lit(blocks)).cast("int")), "block")
    scores = [way(F.col("name"), F.col("listed")) for way in (ways or WAYS).values()]
    return pairs.select("name", "listed", (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("score")).where(F.col("score") >= at_least)
