"""Memory: relevance, recall, vector search, decay, consolidation, grounding, embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import cosine

#: Function words of English, Spanish, French, Portuguese, Italian and German.
STOP_WORDS = (
    "the and for are was were what which who whom how why when where does did can could with from this that these those "
    "you your our their his her its have has had not but all any about into than then them they there here que qué "
    "los las del una unos unas por con para como cómo cuando cuándo donde dónde quien quién cual cuál cuales esta está este estos "
    "estas están eso esa ese son era eran hay sus sobre desde entre hasta muy mas más porque les des une dans pour avec "
    "est sont qui quoi comment não uma dos das der die und ist sind mit für wie wer nicht che per non sono "
).split()
PASSAGES, OVERFETCH = 24, 48


def question_terms(question: Column) -> Column:
    """Distinct words of three letters at least, in lower case, without stop words."""
    words = F.split(F.lower(question), r"[^\p{L}\p{N}]+")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def coverage(terms: Column, text: Column) -> Column:
    """The share of the terms that the text holds."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda x: F.contains(low, x))) / F.nullif(F.size(terms).cast("double"), F.lit(0.0))


def tag_share(tags: Column, wanted: list[str]) -> Column:
    if not wanted:
        return F.lit(0.0)
    return F.size(F.array_intersect(tags, F.array(*[F.lit(w) for w in wanted]))) / float(len(wanted))


def stm_relevance(now_s: float, tags: list[str], text: str | None, vector: Column | None = None) -> Column:
    age_h = (F.lit(float(now_s)) - F.col("created_s")) / 3600.0
    hit = F.when(F.contains(F.lower("text"), F.lit(text.lower())), 0.2).otherwise(0.0) if text else F.lit(0.0)
    close = 0.15 * cosine(F.col("embedding"), vector) if vector is not None else F.lit(0.0)
    return F.least(F.lit(1.0), 0.3 * F.col("attention") + 0.2 * F.col("importance") + 0.2 / (1 + age_h) + 0.15 * tag_share(F.col("tags"), tags) + close + hit)


def ltm_relevance(tags: list[str], text: str | None, vector: Column | None = None) -> Column:
    hit = F.when(F.contains(F.lower("text"), F.lit(text.lower())), 0.15).otherwise(0.0) if text else F.lit(0.0)
    close = 0.25 * cosine(F.col("embedding"), vector) if vector is not None else F.lit(0.0)
    return F.least(F.lit(1.0), 0.3 * F.col("importance") + 0.3 * tag_share(F.col("tags"), tags) + close + hit)


def recall(memories: DataFrame, now_s: float, limit: int, tags: list[str], text: str | None = None) -> DataFrame:
    """id, tier, relevance: the best of either tier, merged, by relevance and id."""
    best = None
    for tier, score in (("stm", stm_relevance(now_s, tags, text)), ("ltm", ltm_relevance(tags, text))):
        own = memories.where(F.col("tier") == tier).select("id", "tier", F.round(score, 6).alias("relevance")).orderBy(F.desc("relevance"), "id").limit(limit)
        best = own if best is None else best.unionByName(own)
    return best.orderBy(F.desc("relevance"), "id").limit(limit)


def vector_search(vectors: DataFrame, query: Column, k: int, least: float) -> DataFrame:
    """id, score: exact cosine, a top-k without a full sort, then the least score."""
    return vectors.select("id", F.round(cosine(F.col("vec"), query), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k).where(F.col("score") >= least)


def decayed(attention: Column, factor: float, intervals: Column) -> Column:
    return attention * F.pow(F.lit(factor), intervals)


def record_access(memories: DataFrame, ids: DataFrame, now_s: int) -> DataFrame:
    """memories with one access more of each id in ids(id): counted, dated, and attention raised by a fifth up to 1."""
    seen = ids.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    rows = memories.join(seen, "id", "left")
    hit = F.col("_n").isNotNull()
    raised = F.least(F.lit(1.0), F.col("attention") + 0.2 * F.col("_n"))
    out = rows.withColumns({"access_count": F.when(hit, F.col("access_count") + F.col("_n")).otherwise(F.col("access_count")), "attention": F.when(hit, raised).otherwise(F.col("attention")), "last_accessed_s": F.when(hit, F.lit(now_s).cast("long"))})
    return out.drop("_n")


def prune(memories: DataFrame, least: float) -> DataFrame:
    return memories.where(F.col("consolidated") | (F.col("attention") >= least))


def evict(memories: DataFrame, capacity: int) -> DataFrame:
    """The `capacity` memories with most attention, older ids first."""
    return memories.orderBy(F.desc("attention"), "id").limit(capacity)


def consolidation_candidates(memories: DataFrame, importance: float, accesses: int, now_s: int, min_age_s: int, batch: int) -> DataFrame:
    ready = memories.where((F.col("importance") >= importance) & ~F.col("consolidated") & (F.col("access_count") >= accesses) & (F.lit(now_s) - F.col("created_s") >= min_age_s))
    return ready.orderBy(F.desc("importance"), "id").limit(batch)


def strategy_scores(now_s: float, novelty: Column) -> dict[str, Column]:
    recency = 1 / (1 + (F.lit(float(now_s)) - F.col("created_s")) / 3600.0)
    frequency = F.least(F.lit(1.0), F.col("access_count") / 10.0)
    return {"frequency": frequency, "importance": F.col("importance"), "novelty": novelty, "combined": 0.35 * F.col("importance") + 0.25 * frequency + 0.15 * recency + 0.25 * novelty}


def knowledge_links(memories: DataFrame) -> DataFrame:
    """source, relation, target: an entity tagged with each of its tags."""
    tags = F.transform(F.col("tags"), lambda x: F.trim(F.lower(x)))
    return memories.select(F.concat(F.lit("memory:"), F.col("id").cast("string")).alias("source"), F.lit("TAGGED").alias("relation"), F.explode(tags).alias("target"))


def ground(memories: DataFrame, question: str, query: Column, now_s: float, k: int = 8, strong: float = 0.35) -> DataFrame:
    """verdict, strong, coverage, passages: recall more than k, rerank by cosine, and judge the k best."""
    some = recall(memories, now_s, max(k, PASSAGES), [], None).select("id")
    top = memories.join(F.broadcast(some), "id").select("id", "text", cosine(F.col("embedding"), query).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    terms = question_terms(F.lit(question))
    good = top.withColumn("good", F.col("score") >= strong)
    out = good.agg(F.count(F.lit(1)).alias("passages"), F.count_if("good").alias("strong"), F.concat_ws(" ", F.collect_list(F.when(F.col("good"), F.col("text")))).alias("text"))
    out = out.withColumn("coverage", F.coalesce(coverage(terms, F.col("text")), F.lit(0.0))).drop("text")
    return out.withColumn("verdict", F.when((F.col("strong") >= 2) & (F.col("coverage") >= 0.6), "grounded").when(F.col("strong") >= 1, "weak").otherwise("ungrounded"))


def embed(texts: Column, dim: int = 64) -> Column:
    """A hashed vector of unit length: each word's SHA-256 bytes, centred, summed over the words; only 32 of the numbers are filled."""
    import hashlib

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for text in batch:
                v = np.zeros(dim)
                for w in (text or "").lower().split():
                    digest = np.frombuffer(hashlib.sha256(w.encode()).digest(), np.uint8)
                    v[: min(dim, 32)] += digest[: min(dim, 32)] / 127.5 - 1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32))
            yield pd.Series(out)

    return run(texts)


def passage(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
