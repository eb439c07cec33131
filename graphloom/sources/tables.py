"""The star-schema tables read as graph models: one mapping, in SQL expressions that any engine reads.

triples() is a union of one projection for each predicate, each with literal predicate and kind. A
filter on the predicate folds the other branches away, and one on a column reaches the Parquet
scan. Names are computed (customer:5 from a key), which no filter can look into, so bound positions are
given to triples() itself: it drops the tables that can't hold them and turns names back into keys,
which are pushed to the scan. every_triple() reads each table once and gives all its facts from a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model

#: (table, subject, predicate, kind, payload column, payload)
FACTS = (
    ("customer", "'customer:' || c_custkey", "rdf:type", "Node", "node", "'type:Customer'"),
    ("customer", "'customer:' || c_custkey", "has_name", "String", "str", "c_name"),
    ("customer", "'customer:' || c_custkey", "segment", "String", "str", "c_mktsegment"),
    ("customer", "'customer:' || c_custkey", "acctbal", "Float", "dbl", "c_acctbal"),
    ("customer", "'customer:' || c_custkey", "in_nation", "Node", "node", "'nation:' || c_nationkey"),
    ("nation", "'nation:' || n_nationkey", "rdf:type", "Node", "node", "'type:Nation'"),
    ("nation", "'nation:' || n_nationkey", "has_name", "String", "str", "n_name"),
    ("nation", "'nation:' || n_nationkey", "in_region", "Node", "node", "'region:' || n_regionkey"),
    ("region", "'region:' || r_regionkey", "rdf:type", "Node", "node", "'type:Region'"),
    ("region", "'region:' || r_regionkey", "has_name", "String", "str", "r_name"),
    ("supplier", "'supplier:' || s_suppkey", "rdf:type", "Node", "node", "'type:Supplier'"),
    ("supplier", "'supplier:' || s_suppkey", "has_name", "String", "str", "s_name"),
    ("supplier", "'supplier:' || s_suppkey", "acctbal", "Float", "dbl", "s_acctbal"),
    ("supplier", "'supplier:' || s_suppkey", "in_nation", "Node", "node", "'nation:' || s_nationkey"),
    ("part", "'part:' || p_partkey", "rdf:type", "Node", "node", "'type:Part'"),
    ("part", "'part:' || p_partkey", "has_name", "String", "str", "p_name"),
    ("part", "'part:' || p_partkey", "brand", "String", "str", "p_brand"),
    ("part", "'part:' || p_partkey", "part_type", "String", "str", "p_type"),
    ("part", "'part:' || p_partkey", "size", "Integer", "int", "p_size"),
    ("orders", "'order:' || o_orderkey", "rdf:type", "Node", "node", "'type:Order'"),
    ("orders", "'order:' || o_orderkey", "placed_by", "Node", "node", "'customer:' || o_custkey"),
    ("orders", "'order:' || o_orderkey", "status", "String", "str", "o_orderstatus"),
    ("orders", "'order:' || o_orderkey", "priority", "String", "str", "o_orderpriority"),
    ("orders", "'order:' || o_orderkey", "totalprice", "Float", "dbl", "o_totalprice"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPES = {f.name: f.dataType.simpleString() for f in model.SCHEMA.fields}


def _cells(fact: tuple) -> str:
    """The columns of a fact as a select list."""
    _, subject, predicate, kind, column, payload = fact
    cells = ", ".join(f"CAST({payload if x == column else 'NULL'} AS {_TYPES[x]}) AS `{x}`" for x in model.PAYLOAD)
    return f"{subject} AS subject, 'named' AS subject_kind, '{predicate}' AS predicate, '{kind}' AS kind, {cells}"


def _key(expression: str, name: str) -> str | None:
    """The condition on a table's column that makes a name expression give this name; 'true' if it always does, None if it can't."""
    prefix, _, column = expression.partition("' || ")
    prefix = prefix[1:]
    if not column:
        return "true" if expression == f"'{name}'" else None
    rest = name.removeprefix(prefix)
    return f"{column} = {rest}" if name.startswith(prefix) and rest.lstrip("-").isdigit() and str(int(rest)) == rest else None


def _condition(fact: tuple, subject: str | None, predicate: str | None, obj: dict) -> str | None:
    """What a fact's table must hold for the bound positions; None if it can't hold them."""
    _, name, own, kind, column, payload = fact
    if predicate not in (None, own) or obj.get("kind", kind) != kind or any(x is not None and k not in ("kind", column) for k, x in obj.items()):
        return None
    found = ["true" if subject is None else _key(name, subject)]
    if obj.get(column) is not None:
        x = obj[column]
        if column == "node":
            found.append(_key(payload, x))
        elif isinstance(x, str):
            quoted = x.replace("\\", "\\\\").replace("'", "\\'")
            found.append(f"{payload} = '{quoted}'")
        else:
            found.append(f"{payload} = {x!r}")
    return None if None in found else " AND ".join(x for x in found if x != "true") or "true"


def triples(spark: SparkSession, sf_dir: str, subject: str | None = None, predicate: str | None = None, obj: dict | None = None) -> DataFrame:
    """Facts of the star schema as triples, all or those of the bound positions; in one statement, parsed and analysed once.

    obj: kind and payload columns, as in operators.graph.pattern().
    """
    rows, used = [], set()
    for fact in FACTS:
        where = _condition(fact, subject, predicate, obj or {})
        if where is not None:
            used.add(fact[0])
            rows.append(f"SELECT {_cells(fact)} FROM {{{fact[0]}}}" + ("" if where == "true" else f" WHERE {where}"))
    if not rows:
        return spark.createDataFrame([], model.SCHEMA)
    return spark.sql(" UNION ALL ".join(rows), **{name: table(spark, sf_dir, name) for name in sorted(used)})


def every_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts, with one scan of each table: a row gives its facts as an array that is laid out."""
    names = ("subject", "subject_kind", "predicate", "kind", *model.PAYLOAD)
    rows = []
    for name in sorted({f[0] for f in FACTS}):
        facts = []
        for _, subject, predicate, kind, column, payload in (f for f in FACTS if f[0] == name):
            cells = [subject, "'named'", f"'{predicate}'", f"'{kind}'", *[f"CAST({payload if x == column else 'NULL'} AS {_TYPES[x]})" for x in model.PAYLOAD]]
            facts.append("named_struct(" + ", ".join(f"'{n}', {x}" for n, x in zip(names, cells)) + ")")
        rows.append(f"SELECT inline(array({', '.join(facts)})) FROM {{{name}}}")
    return spark.sql(" UNION ALL ".join(rows), **{name: table(spark, sf_dir, name) for name in sorted({f[0] for f in FACTS})})


def triples_sql() -> str:
    """The same rows as a SELECT for an ANSI engine."""
    casts = {"node": "VARCHAR", "str": "VARCHAR", "int": "BIGINT", "dbl": "DOUBLE", "bool": "BOOLEAN", "datatype": "VARCHAR", "lang": "VARCHAR"}
    rows = []
    for name, subject, predicate, kind, column, payload in FACTS:
        cells = ", ".join(f'CAST({payload if x == column else "NULL"} AS {t}) AS "{x}"' for x, t in casts.items())
        rows.append(f"SELECT {subject} AS subject, 'named' AS subject_kind, '{predicate}' AS predicate, '{kind}' AS kind, {cells} FROM {name}")
    return " UNION ALL ".join(rows)


# --- trace events --------------------------------------------------------------------------------

def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, event_type, agent, ts, session, parent (the user's event before), seq, value, props."""
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.col("event_id").alias("id"),
        "event_type",
        F.col("user_id").alias("agent"),
        "ts",
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
        F.lag("event_id").over(own).alias("parent"),
        F.row_number().over(own).cast("long").alias("seq"),
        "value",
        "props",
    )


EVENTS_SQL = """SELECT event_id AS id, event_type, user_id AS agent, ts, CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS session,
 lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, value, props FROM events"""


# --- action DAG ----------------------------------------------------------------------------------


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, parents, author, seq, ts, op, triple_key: each user's events as a chain; every tenth event (by id) also
    has the event before it as a parent, whoever wrote that. Errors delete the fact that the others insert."""
    e = trace_events(spark, sf_dir)
    merge = F.when((F.col("id") % 10 == 0) & (F.col("id") > 0), F.col("id") - 1)
    parents = F.array_distinct(F.array_compact(F.array("parent", merge)))
    key = F.concat_ws("|", F.col("agent").cast("string"), F.when(F.col("event_type") == "error", "view").otherwise(F.col("event_type")), F.floor(F.col("value") / 50).cast("string"))
    return e.select(F.col("id").alias("hash"), parents.alias("parents"), F.col("agent").alias("author"), "seq", "ts", F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("op"), key.alias("triple_key"))


ACTIONS_SQL = f"""SELECT id AS hash, list_sort(list_distinct(list_filter([parent, CASE WHEN id % 10 = 0 AND id > 0 THEN id - 1 END], lambda x: x IS NOT NULL))) AS parents,
 agent AS author, seq, ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS op,
 CAST(agent AS VARCHAR) || '|' || CASE WHEN event_type = 'error' THEN 'view' ELSE event_type END || '|' || CAST(CAST(floor(value / 50) AS BIGINT) AS VARCHAR) AS triple_key
 FROM ({EVENTS_SQL})"""


# --- memory, notes -------------------------------------------------------------------------------


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tier, entry_type, text, importance, attention, access_count, created_s, consolidated, tags, embedding."""
    d, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    m = d.join(v, F.col("doc_id") == F.col("vec_id"), "left")
    return m.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 3 == 0, "stm").otherwise("ltm").alias("tier"),
        F.col("source").alias("entry_type"),
        "text",
        ((F.col("n_chars") % 100) / 100).alias("importance"),
        ((F.col("doc_id") % 10) / 10).alias("attention"),
        (F.col("doc_id") % 7).cast("int").alias("access_count"),
        F.col("doc_id").alias("created_s"),
        (F.col("doc_id") % 5 == 0).alias("consolidated"),
        F.array("lang", "source").alias("tags"),
        "embedding",
    )


MEMORIES_SQL = """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'stm' ELSE 'ltm' END AS tier, source AS entry_type, text,
 (n_chars % 100) / 100.0::DOUBLE AS importance, (doc_id % 10) / 10.0::DOUBLE AS attention, CAST(doc_id % 7 AS INTEGER) AS access_count, doc_id AS created_s,
 doc_id % 5 = 0 AS consolidated, [lang, source] AS tags, embedding FROM documents LEFT JOIN embeddings ON doc_id = vec_id"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, lang, source, doc_id, text of documents as notes of a vault."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "lang", "source", "doc_id", "text")


NOTES_SQL = "SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, lang, source, doc_id, text FROM documents"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: two links of each document by its number, none to itself, none from every eleventh."""
    n = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("n"))
    d = table(spark, sf_dir, "documents").select("doc_id")
    both = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("src"), F.explode(F.array((F.col("doc_id") * 7 + 1) % n.scalar(), (F.col("doc_id") * 13 + 5) % n.scalar())).alias("dst"))
    return both.where("src <> dst").distinct()


LINKS_SQL = """SELECT DISTINCT src, dst FROM (SELECT doc_id AS src, unnest([(doc_id * 7 + 1) % n, (doc_id * 13 + 5) % n]) AS dst
 FROM documents, (SELECT max(doc_id) + 1 AS n FROM documents) WHERE doc_id % 11 <> 0) WHERE src <> dst"""


# --- source chain --------------------------------------------------------------------------------


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, author, seq, prev_hash, type, entry_hash, target, ts, price of lineitems as the chains of their suppliers.

    Returned items (R) are updates and a quarter of the open (N, by part number) deletes of the header before; the rest creates.
    """
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    own = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    name = F.concat_ws("-", *[F.col(x).cast("long").cast("string") for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")])
    rows = li.select(
        name.alias("hash"),
        F.col("l_suppkey").alias("author"),
        (F.row_number().over(own) - 1).cast("long").alias("seq"),
        F.lag(name).over(own).alias("prev_hash"),
        F.when(F.col("l_returnflag") == "R", "Update").when((F.col("l_returnflag") == "N") & (F.col("l_partkey") % 4 == 0), "Delete").otherwise("Create").alias("type"),
        F.col("l_orderkey").alias("entry_hash"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_linestatus").alias("state"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_partkey").alias("base"),
    )
    return rows.withColumn("target", F.when(F.col("type") != "Create", F.col("prev_hash")))


HEADERS_SQL = """SELECT *, CASE WHEN type <> 'Create' THEN prev_hash END AS target FROM (SELECT name AS hash, l_suppkey AS author,
 row_number() OVER w - 1 AS seq, lag(name) OVER w AS prev_hash,
 CASE WHEN l_returnflag = 'R' THEN 'Update' WHEN l_returnflag = 'N' AND l_partkey % 4 = 0 THEN 'Delete' ELSE 'Create' END AS type,
 l_orderkey AS entry_hash, l_shipdate AS ts, l_linestatus AS state, l_quantity AS quantity, l_partkey AS base
 FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || CAST(l_quantity AS BIGINT) AS name FROM lineitem)
 WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity))"""


# --- ownership -----------------------------------------------------------------------------------


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner (supplier), owned (customer), quantity (whole units), total of the customer: shares are quantity / total."""
    from pyspark.sql import Window

    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("l_suppkey").alias("owner"), F.col("o_custkey").alias("owned")).agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return pairs.withColumn("total", F.sum("quantity").over(Window.partitionBy("owned")))


OWNERSHIP_SQL = """SELECT *, CAST(sum(quantity) OVER (PARTITION BY owned) AS BIGINT) AS total FROM (SELECT l_suppkey AS owner, o_custkey AS owned, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
