"""Memory, vectors and retrieval (inventory 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as m
from ..operators import similarity as sim
from ..registry import query
from ..sources import tables as t

M = t.MEMORIES_SQL
NOW = 1_000_000
VEC = "CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])"


def probe(spark, d):
    """The first vector as a constant: one row, by its id."""
    row = t.table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row[0]])


@query("cosine", f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VEC}), 6) AS score FROM embeddings")
def cosine(spark, d):
    return t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(sim.cosine(F.col("embedding"), probe(spark, d)), 6).alias("score"))


TAGS = "(CASE WHEN list_contains(tags, 'en') THEN 1 ELSE 0 END + CASE WHEN list_contains(tags, 'src1') THEN 1 ELSE 0 END) / 2.0::DOUBLE"
STM = f"round(least(1.0::DOUBLE, 0.3 * attention + 0.2 * importance + 0.2 / (1 + ({NOW} - created_s) / 3600.0::DOUBLE) + 0.15 * {TAGS} + CASE WHEN contains(lower(text), 'ing') THEN 0.2 ELSE 0 END), 6)"
LTM = f"round(least(1.0::DOUBLE, 0.3 * importance + 0.3 * {TAGS} + CASE WHEN contains(lower(text), 'ing') THEN 0.15 ELSE 0 END), 6)"


@query("stm_relevance", f"SELECT id, {STM} AS relevance FROM ({M}) WHERE tier = 'stm'")
def stm_relevance(spark, d):
    return t.memories(spark, d).where("tier = 'stm'").select("id", F.round(m.stm_relevance(NOW, ["en", "src1"], "ing"), 6).alias("relevance"))


@query("ltm_relevance", f"SELECT id, {LTM} AS relevance FROM ({M}) WHERE tier = 'ltm'")
def ltm_relevance(spark, d):
    return t.memories(spark, d).where("tier = 'ltm'").select("id", F.round(m.ltm_relevance(["en", "src1"], "ing"), 6).alias("relevance"))


RECALL = f"""SELECT id, tier, relevance FROM ((SELECT id, tier, {STM} AS relevance FROM ({M}) WHERE tier = 'stm' ORDER BY relevance DESC, id LIMIT 20)
 UNION ALL (SELECT id, tier, {LTM} AS relevance FROM ({M}) WHERE tier = 'ltm' ORDER BY relevance DESC, id LIMIT 20)) ORDER BY relevance DESC, id LIMIT 20"""


@query("recall", RECALL)
def recall(spark, d):
    return m.recall(t.memories(spark, d), NOW, 20, ["en", "src1"], "ing")


@query("host_memory_recall", RECALL.replace("LIMIT 20", "LIMIT 5"))
def host_memory_recall(spark, d):
    return m.recall(t.memories(spark, d), NOW, 5, ["en", "src1"], "ing")


@query("memory_filter", f"SELECT id FROM ({M}) WHERE tier = 'stm' AND importance >= 0.5 AND created_s BETWEEN 10 AND 700 AND (list_contains(tags, 'de') OR list_contains(tags, 'fr'))")
def memory_filter(spark, d):
    return t.memories(spark, d).where((F.col("tier") == "stm") & (F.col("importance") >= 0.5) & F.col("created_s").between(10, 700) & F.arrays_overlap("tags", F.array(F.lit("de"), F.lit("fr")))).select("id")


@query("candidate_pruning", f"SELECT id FROM ({M}) WHERE list_contains(tags, 'es')")
def candidate_pruning(spark, d):
    return t.memories(spark, d).where(F.array_contains("tags", "es")).select("id")


def searched(name: str, k: int, least: float) -> None:
    @query(name, f"SELECT id, score FROM (SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VEC}), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT {k}) WHERE score >= {least}")
    def run(spark, d):
        return m.vector_search(t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), probe(spark, d), k, least)


searched("semantic_search", 20, -1.0)
searched("vector_search", 50, 0.2)


@query("vector_result_filter", f"SELECT id, score FROM (SELECT vec_id AS id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VEC}), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 50) WHERE label < 5")
def vector_result_filter(spark, d):
    found = m.vector_search(t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), probe(spark, d), 50, -2.0)
    return found.join(t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").where("label < 5").select("id", "score")


@query("hnsw_search")
def hnsw_search(spark, d):
    v = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    from ..operators.vectors import VectorIndex

    return VectorIndex.build(v, 64).search(v.where("id % 100 = 0"), 10).select("query", "id", "score")


@query("hnsw_stats", "SELECT count(*) AS vectors FROM embeddings WHERE vec_id % 3 <> 0")
def hnsw_stats(spark, d):
    """After a build of the even ids, an insert of the rest, a removal and a rebuild."""
    from ..operators.vectors import VectorIndex

    v = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    index = VectorIndex.build(v.where("id % 2 = 0"), 64).insert(v.where("id % 2 = 1")).remove(v.where("id % 3 = 0").select("id")).rebuild()
    return index.stats().select("vectors")


@query("decay", f"SELECT id, round(attention * pow(0.9, access_count), 6) AS attention FROM ({M})")
def decay(spark, d):
    return t.memories(spark, d).select("id", F.round(m.decayed(F.col("attention"), 0.9, F.col("access_count")), 6).alias("attention"))


@query("memory_prune", f"SELECT id FROM ({M}) WHERE consolidated OR attention >= 0.3")
def memory_prune(spark, d):
    return m.prune(t.memories(spark, d), 0.3).select("id")


@query("memory_evict", f"SELECT id FROM ({M}) WHERE tier = 'stm' ORDER BY attention DESC, id LIMIT 100")
def memory_evict(spark, d):
    return m.evict(t.memories(spark, d).where("tier = 'stm'"), 100).select("id")


@query("consolidation_candidates", f"SELECT id FROM ({M}) WHERE importance >= 0.4 AND NOT consolidated AND access_count >= 2 AND {NOW} - created_s >= 3600 ORDER BY importance DESC, id LIMIT 50")
def consolidation_candidates(spark, d):
    return m.consolidation_candidates(t.memories(spark, d), 0.4, 2, NOW, 3600, 50).select("id")


@query("consolidation_scores", f"SELECT id, round(0.35 * importance + 0.25 * least(1.0::DOUBLE, access_count / 10.0::DOUBLE) + 0.15 / (1 + ({NOW} - created_s) / 3600.0::DOUBLE) + 0.25 * 0.5, 6) AS score FROM ({M})")
def consolidation_scores(spark, d):
    return t.memories(spark, d).select("id", F.round(m.strategy_scores(NOW, F.lit(0.5))["combined"], 6).alias("score"))


@query("extract_knowledge", f"SELECT 'memory:' || id AS source, 'TAGGED' AS relation, trim(lower(tag)) AS target FROM (SELECT id, unnest(tags) AS tag FROM ({M}))")
def extract_knowledge(spark, d):
    return m.knowledge_links(t.memories(spark, d))


@query("ground")
def ground(spark, d):
    return m.ground(t.memories(spark, d), "What is the tion of it?", probe(spark, d), NOW)


CONTEXT = f"SELECT entry_type AS source, id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {VEC}), 6) AS score FROM ({M}) WHERE embedding IS NOT NULL"


@query("note_context", f"SELECT source, arg_max(id, (score, -id)) AS id, max(score) AS score FROM ({CONTEXT}) GROUP BY 1")
def note_context(spark, d):
    rows = t.memories(spark, d).where("embedding is not null").select(F.col("entry_type").alias("source"), "id", F.round(sim.cosine(F.col("embedding"), probe(spark, d)), 6).alias("score"))
    return rows.groupBy("source").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.max("score").alias("score"))


@query("embed")
def embed(spark, d):
    return t.table(spark, d, "documents").select("doc_id", m.embed(F.col("text")).alias("vec"))


@query("q_learning")
def q_learning(spark, d):
    from ..operators import learning

    e = t.table(spark, d, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") / 25).alias("state"), F.col("event_type").alias("action"), (F.col("value") / 100).alias("reward"))
    return learning.q_values(e, "user_id", ["ts", "event_id"], 0.1, 0.9)


@query("sarsa")
def sarsa(spark, d):
    from ..operators import learning

    e = t.table(spark, d, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") / 25).alias("state"), F.col("event_type").alias("action"), (F.col("value") / 100).alias("reward"))
    return learning.q_values(e, "user_id", ["ts", "event_id"], 0.1, 0.9, sarsa=True)


@query("linear_value", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 0.5 + CAST(embedding[2] AS DOUBLE) * 0.25 - CAST(embedding[3] AS DOUBLE), 6) AS value FROM embeddings")
def linear_value(spark, d):
    from ..operators import learning

    w = F.array(F.lit(0.5), F.lit(0.25), F.lit(-1.0))
    return t.table(spark, d, "embeddings").select("vec_id", F.round(learning.linear_value(w, F.slice(F.col("embedding").cast("array<double>"), 1, 3)), 6).alias("value"))


@query("record_access", f"SELECT id, access_count + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS access_count, round(CASE WHEN id % 4 = 0 THEN least(1.0, attention + 0.2) ELSE attention END, 6) AS attention, CASE WHEN id % 4 = 0 THEN 1000 END AS last_accessed_s FROM ({M})")
def record_access(spark, d):
    rows = t.memories(spark, d)
    return m.record_access(rows, rows.where("id % 4 = 0").select("id"), 1000).select("id", "access_count", F.round("attention", 6).alias("attention"), "last_accessed_s")


@query("expected_sarsa")
def expected_sarsa(spark, d):
    from ..operators import learning

    e = t.table(spark, d, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") / 25).alias("state"), F.col("event_type").alias("action"), (F.col("value") / 100).alias("reward"))
    return learning.q_values(e, "user_id", ["ts", "event_id"], 0.1, 0.9, explore=0.1)
