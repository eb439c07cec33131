"""Scalar functions, text structure, tasks and cards (inventory 2.12, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory as m
from ..operators import similarity as sim
from ..operators import vault as v
from ..registry import query
from ..sources import tables as t

N = t.NOTES_SQL


@query("basename", f"SELECT path, CAST(doc_id AS VARCHAR) AS base FROM ({N})")
def basename(spark, d):
    return t.notes(spark, d).select("path", v.basename(F.col("path")).alias("base"))


@query("path_without_ext", f"SELECT path, source || '/' || lang || '/' || doc_id AS bare FROM ({N})")
def path_without_ext(spark, d):
    return t.notes(spark, d).select("path", v.without_extension(F.col("path")).alias("bare"))


@query("strip_brackets", f"SELECT path, path AS bare FROM ({N})")
def strip_brackets(spark, d):
    return t.notes(spark, d).select("path", v.strip_brackets(F.concat(F.lit("<"), "path", F.lit(">"))).alias("bare"))


@query("mentions_word", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])and($|[^\\p{L}\\p{N}])')")
def mentions_word(spark, d):
    return t.table(spark, d, "documents").where(v.mentions(F.col("text"), "and")).select("doc_id")


@query("question_terms", "SELECT 'brown,fox,jump,lazy' AS terms")
def question_terms(spark, d):
    return spark.range(1).select(F.array_join(F.sort_array(m.question_terms(F.lit("Why does the Brown fox jump; is IT lazy, Fox?"))), ",").alias("terms"))


@query("passage", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS passage FROM documents")
def passage(spark, d):
    return t.table(spark, d, "documents").select("doc_id", m.passage(F.col("text")).alias("passage"))


@query("normalize_name", "SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(p_name || ', Jr. '), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def normalize_name(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), sim.normalize_name(F.concat("p_name", F.lit(", Jr. "))).alias("name"))


@query("levenshtein", "SELECT p_partkey AS id, round(1 - levenshtein(p_name, p_type) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE), 6) AS score FROM part")
def levenshtein(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(sim.levenshtein_similarity(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@query("sound_code")
def sound_code(spark, d):
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), sim.sound_code(F.col("p_name")).alias("code"))


@query("token_similarity", "SELECT p_partkey AS id, len(list_intersect(string_split(lower(p_name), ' '), string_split(lower(p_type), ' '))) / CAST(greatest(len(string_split(lower(p_name), ' ')), len(string_split(lower(p_type), ' '))) AS DOUBLE) AS score FROM part")
def token_similarity(spark, d):
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).alias("score"))


@query("valid_date", "SELECT o_orderkey, o_orderkey % 14 BETWEEN 1 AND 12 AS ok FROM orders")
def valid_date(spark, d):
    text = F.format_string("2024-%02d-15", (F.col("o_orderkey") % 14).cast("int"))
    return t.table(spark, d, "orders").select("o_orderkey", v.valid_date(text).alias("ok"))


@query("add_days", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 10, '%Y-%m-%d') AS later FROM orders")
def add_days(spark, d):
    return t.table(spark, d, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 10).cast("string").alias("later"))


@query("json_value", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_value(spark, d):
    return t.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("calibration", "SELECT event_id, CAST(round(value * 100) AS BIGINT) * 3 + 250 AS calibrated FROM events WHERE value >= 10")
def calibration(spark, d):
    return t.table(spark, d, "events").where("value >= 10").select("event_id", (F.round(F.col("value") * 100).cast("long") * 3 + 250).alias("calibrated"))


@query("axis_magnitude", "SELECT vec_id, round(sqrt(pow(CAST(embedding[1] AS DOUBLE), 2) + pow(CAST(embedding[2] AS DOUBLE), 2) + pow(CAST(embedding[3] AS DOUBLE), 2)), 6) AS size FROM embeddings")
def axis_magnitude(spark, d):
    x = lambda i: F.pow(F.col("embedding")[i].cast("double"), 2)
    return t.table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(x(0) + x(1) + x(2)), 6).alias("size"))


@query("jurisdiction_score", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 9 WHEN n_regionkey = 2 THEN 6 ELSE 2 END AS score FROM nation")
def jurisdiction_score(spark, d):
    return t.table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 == 0, 9).when(F.col("n_regionkey") == 2, 6).otherwise(2).alias("score"))


@query("chunk_fixed", "SELECT path, CAST(w * 2 + 1 AS INTEGER) AS line_start, string_agg(line, chr(10) ORDER BY n) AS text FROM (SELECT path, n, line, (n - 1) // 2 AS w FROM (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM (" + N + "))) GROUP BY 1, 2")
def chunk_fixed(spark, d):
    return v.fixed_chunks(t.notes(spark, d).withColumnRenamed("text", "content"), 2).select("path", "line_start", "text")


MD = "'---\\ntags: [' || lang || ', X' || doc_id % 3 || ']\\n---\\n# Note ' || doc_id || '\\nsee [[n' || (doc_id * 7 + 1) % 50 || '|alias]] #tag' || doc_id % 4 || '\\n```\\n[[hidden]]\\n```\\n## Part\\n- [' || CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE ' ' END || '] do ' || doc_id || ' [#' || CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END || '] 📅 2024-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) || ' 🔁 every ' || (doc_id % 3 + 1) || ' days\\n{{cloze c' || doc_id || '}}'"


def markdown(spark, d):
    """Notes with every kind of markup, written from the documents' numbers."""
    return t.table(spark, d, "documents").select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "lang", F.expr(MD).alias("content"))


@query("wikilinks", "SELECT 'n' || doc_id AS path, 'n' || (doc_id * 7 + 1) % 50 AS target FROM documents")
def wikilinks(spark, d):
    return v.unfenced_lines(markdown(spark, d)).select("path", F.explode(v.wikilinks(F.col("line"))).alias("target"))


@query("inline_tags", "SELECT 'n' || doc_id AS path, 'tag' || doc_id % 4 AS tag FROM documents")
def inline_tags(spark, d):
    return v.unfenced_lines(markdown(spark, d)).select("path", F.explode(v.inline_tags(F.col("line"))).alias("tag"))


@query("frontmatter_tags", "SELECT 'n' || doc_id AS path, unnest([lang, 'x' || doc_id % 3]) AS tag FROM documents")
def frontmatter_tags(spark, d):
    return markdown(spark, d).select("path", F.explode(v.frontmatter_tags(F.col("content"))).alias("tag"))


@query("headings", "SELECT 'n' || doc_id AS path, unnest(['# Note ' || doc_id, '## Part']) AS heading FROM documents")
def headings(spark, d):
    return v.heading_chunks(markdown(spark, d)).where("heading is not null").select("path", "heading")


@query("chunk_markdown")
def chunk_markdown(spark, d):
    return v.heading_chunks(markdown(spark, d))


TASK = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'done' ELSE 'todo' END AS status, 'do ' || doc_id AS text, CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, '2024-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) AS due, (doc_id % 3 + 1) || 'd' AS recurrence FROM documents"


def tasks(spark, d):
    rows = markdown(spark, d).select("doc_id", F.explode(F.split("content", "\n")).alias("line")).select("doc_id", v.parse_task(F.col("line")).alias("t")).where("t is not null")
    return rows.select("doc_id", "t.*")


@query("parse_task", TASK)
def parse_task(spark, d):
    return tasks(spark, d).select("doc_id", "status", "text", "priority", "due", "recurrence")


@query("list_tasks", f"SELECT text, priority, due FROM ({TASK}) ORDER BY due, CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, text LIMIT 100")
def list_tasks(spark, d):
    return tasks(spark, d).orderBy(*v.task_order()).limit(100).select("text", "priority", "due")


@query("agenda", f"SELECT text, CASE WHEN due < '2024-05-14' THEN 'overdue' WHEN due = '2024-05-14' THEN 'today' ELSE 'upcoming' END AS bucket FROM ({TASK}) WHERE status = 'todo' AND due <= '2024-06-13'")
def agenda(spark, d):
    return v.agenda(tasks(spark, d), "2024-05-14", 30).select("text", "bucket")


CARD = "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN '2024-0' || (doc_id % 9 + 1) || '-11' END AS due FROM documents"


@query("list_cards", f"SELECT doc_id, due, CASE WHEN due IS NULL THEN 'new' WHEN due <= '2024-05-14' THEN 'due' ELSE 'scheduled' END AS status FROM ({CARD})")
def list_cards(spark, d):
    due = F.expr("case when doc_id % 5 <> 0 then '2024-0' || (doc_id % 9 + 1) || '-11' end")
    return t.table(spark, d, "documents").select("doc_id", due.alias("due")).select("doc_id", "due", v.card_status(F.col("due"), "2024-05-14").alias("status"))


@query("due_cards", f"SELECT doc_id, due FROM ({CARD}) WHERE due <= '2024-05-14' ORDER BY due, doc_id LIMIT 50")
def due_cards(spark, d):
    return list_cards(spark, d).where("status = 'due'").orderBy("due", "doc_id").limit(50).select("doc_id", "due")


@query("cloze", "SELECT 'n' || doc_id AS path, 'c' || doc_id AS cloze FROM documents")
def cloze(spark, d):
    return markdown(spark, d).select("path", F.explode(v.cloze(F.col("content"))).alias("cloze"))


CARDS = "'Capital of ' || lang || ' {{cloze c' || doc_id || ' \\\\\\\\ hint ' || doc_id % 3 || '}} #card <!-- srs ef=2.5 int=' || doc_id % 9 || ' due=2024-0' || (doc_id % 9 + 1) || '-11 last=2024-13-01 q=x -->'"


@query("parse_card", "SELECT doc_id, 'Capital of ' || lang || ' {{cloze c' || doc_id || ' \\\\ hint ' || doc_id % 3 || '}}' AS front, 'c' || doc_id AS answer, 'hint ' || doc_id % 3 AS hint, '2.5' AS ef, CAST(doc_id % 9 AS VARCHAR) AS \"int\", '2024-0' || (doc_id % 9 + 1) || '-11' AS due, CAST(NULL AS VARCHAR) AS last FROM documents")
def parse_card(spark, d):
    rows = t.table(spark, d, "documents").select("doc_id", v.parse_card(F.expr(CARDS)).alias("c"))
    return rows.select("doc_id", "c.front", F.col("c.clozes")[0]["answer"].alias("answer"), F.col("c.clozes")[0]["hint"].alias("hint"), "c.ef", "c.int", "c.due", "c.last")


@query("neutralize", "SELECT n_nationkey, 'a\\*b \\[x\\] \\#' || n_nationkey AS text FROM nation")
def neutralize(spark, d):
    return t.table(spark, d, "nation").select("n_nationkey", v.neutralize(F.expr("'a*b [x] #' || n_nationkey")).alias("text"))
