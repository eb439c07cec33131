"""Joins over chains, notes, names and vectors (inventory 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain as ch
from ..operators import graph as g
from ..operators import similarity as sim
from ..operators import traces
from ..registry import query
from ..sources import tables as t

H = f"WITH h AS MATERIALIZED ({t.HEADERS_SQL}) "
DELETED = "(SELECT target FROM h WHERE type = 'Delete' AND target IS NOT NULL)"
#: The same headers and the distinct targets of deletes, for anti joins.
HD = H.rstrip() + ", del AS MATERIALIZED (SELECT DISTINCT target FROM h WHERE type = 'Delete' AND target IS NOT NULL) "


@query("star_pivot", "SELECT 'customer:' || c_custkey AS subject, c_name AS name, c_mktsegment AS segment, 'nation:' || c_nationkey AS nation FROM customer")
def star_pivot(spark, d):
    rows = t.triples(spark, d).where("subject like 'customer:%'")
    return g.star(rows, {"name": "has_name", "segment": "segment", "nation": "in_nation"}, ("name",))


@query("live_element", HD + "SELECT hash, type FROM h ANTI JOIN del ON h.hash = del.target WHERE type <> 'Delete'")
def live_element(spark, d):
    return ch.live_elements(t.headers(spark, d)).select("hash", "type")


@query("live_entry", H + f"SELECT DISTINCT entry_hash FROM h WHERE type <> 'Delete' AND hash NOT IN {DELETED}")
def live_entry(spark, d):
    return ch.live_entries(t.headers(spark, d))


@query("element_details", H + "SELECT a.hash, a.state = 'F' AS valid, count(*) FILTER (b.type = 'Update') AS updates, count(*) FILTER (b.type = 'Delete') AS deletes FROM h a LEFT JOIN h b ON b.target = a.hash WHERE a.type <> 'Delete' GROUP BY 1, 2")
def element_details(spark, d):
    return ch.element_details(t.headers(spark, d))


@query("entry_details", H + f"SELECT entry_hash, count(*) FILTER (type = 'Create') AS creates, count(*) FILTER (type = 'Update') AS updates, count(*) FILTER (type = 'Delete') AS deletes, bool_or(type <> 'Delete' AND hash NOT IN {DELETED}) AS live FROM h GROUP BY 1")
def entry_details(spark, d):
    return ch.entry_details(t.headers(spark, d))


@query("get_links", HD + """SELECT hash, base, author AS "to", hex(hash) AS tag FROM h ANTI JOIN del ON h.hash = del.target WHERE type = 'Create' AND starts_with(hex(hash), '31')""")
def get_links(spark, d):
    return ch.links(t.headers(spark, d), "31")


@query("link_details", H + "SELECT hash, base, 'create' AS what FROM h WHERE type = 'Create' UNION ALL SELECT x.hash, c.base, 'delete' FROM h x JOIN h c ON x.target = c.hash WHERE x.type = 'Delete' AND c.type = 'Create'")
def link_details(spark, d):
    return ch.link_details(t.headers(spark, d))


@query("element_by_hash", H + "SELECT hash, type, o_orderstatus AS entry_status FROM h LEFT JOIN orders ON entry_hash = o_orderkey WHERE starts_with(hash, '7-') OR starts_with(hash, '12-')")
def element_by_hash(spark, d):
    own = t.headers(spark, d).where(F.col("hash").startswith("7-") | F.col("hash").startswith("12-"))
    return own.join(t.table(spark, d, "orders"), F.col("entry_hash") == F.col("o_orderkey"), "left").select("hash", "type", F.col("o_orderstatus").alias("entry_status"))


@query("chain_head", H + "SELECT author, max_by(hash, seq) AS hash, max(seq) AS seq FROM h GROUP BY 1")
def chain_head(spark, d):
    return ch.chain_heads(t.headers(spark, d))


@query("chain_dump", H + "SELECT seq, hash, type, entry_hash, o_orderstatus AS entry_status FROM h LEFT JOIN orders ON entry_hash = o_orderkey WHERE author = 1")
def chain_dump(spark, d):
    return ch.dump(t.headers(spark, d), t.table(spark, d, "orders"), 1)


@query("chain_query", H + "SELECT hash, seq, type FROM h WHERE author = 3 AND seq >= 5 AND seq < 40 AND type IN ('Create', 'Update')")
def chain_query(spark, d):
    return t.headers(spark, d).where("author = 3 and seq >= 5 and seq < 40 and type in ('Create', 'Update')").select("hash", "seq", "type")


@query("cap_grants", H + "SELECT author, min(CAST(left(o_orderpriority, 1) AS INTEGER)) AS access, count(*) AS grants FROM h JOIN orders ON entry_hash = o_orderkey WHERE type = 'Create' AND hash NOT IN (SELECT target FROM h WHERE target IS NOT NULL) AND left(o_orderpriority, 1) IN ('1', '2', '3') GROUP BY 1")
def cap_grants(spark, d):
    return ch.cap_grants(t.headers(spark, d), t.table(spark, d, "orders"))


@query("integrate_ready", H.rstrip() + ", fin AS MATERIALIZED (SELECT hash AS done FROM h WHERE state = 'F'), n AS (SELECT hash, type, CASE WHEN type = 'Create' THEN prev_hash ELSE target END AS need FROM h WHERE state = 'O') SELECT hash, type FROM n SEMI JOIN fin ON need = done UNION ALL SELECT hash, type FROM n WHERE type = 'Create' AND need IS NULL")
def integrate_ready(spark, d):
    return ch.integrate_ready(t.headers(spark, d))


OPS = H + "SELECT hash, author, seq, o_orderpriority AS priority FROM h JOIN orders ON entry_hash = o_orderkey WHERE "


def ops(name: str, where: str) -> None:
    @query(name, OPS + where)
    def run(spark, d):
        rows = t.headers(spark, d).join(t.table(spark, d, "orders"), F.col("entry_hash") == F.col("o_orderkey"))
        return rows.where(where).select("hash", "author", "seq", F.col("o_orderpriority").alias("priority")).orderBy("author", "seq")


ops("ops_to_publish", "state = 'O' AND type = 'Create' AND quantity >= 40")
ops("ops_to_validate", "state = 'O' AND type <> 'Create' AND quantity < 10")
ops("receipts_due", "state = 'F' AND quantity = 50")


@query("ops_by_hash", H + "SELECT hash, author FROM h WHERE state = 'F' AND entry_hash IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def ops_by_hash(spark, d):
    wanted = t.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("entry_hash"))
    return t.headers(spark, d).where("state = 'F'").join(wanted, "entry_hash", "left_semi").select("hash", "author")


@query("agent_activity", H + "SELECT author, count(*) AS n, -1 AS fork_at, -1 AS gap_at FROM h GROUP BY 1")
def agent_activity(spark, d):
    return ch.activity(t.headers(spark, d)).fillna(-1, ["fork_at", "gap_at"])


@query("fork_detect", "SELECT author, min(seq) AS fork_at FROM (SELECT user_id AS author, hour(ts) AS seq, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 1 GROUP BY 1")
def fork_detect(spark, d):
    rows = t.table(spark, d, "events").select(F.col("user_id").alias("author"), F.hour("ts").cast("long").alias("seq"), F.col("event_id").alias("hash"))
    return ch.activity(rows).where("fork_at is not null").select("author", "fork_at")


@query("authority_ops", H + f"SELECT base, count(*) AS ops, count(*) FILTER (type = 'Create' AND hash NOT IN {DELETED}) AS live FROM h GROUP BY 1")
def authority_ops(spark, d):
    h = t.headers(spark, d)
    gone = ch.targets(h, "Delete").withColumn("gone", F.lit(1))
    return h.join(gone, "hash", "left").groupBy("base").agg(F.count(F.lit(1)).alias("ops"), F.count_if((F.col("type") == "Create") & F.col("gone").isNull()).alias("live"))


@query("gossip_oldest", "SELECT arg_min(agent, struct_pack(m := moment, a := agent)) AS agent FROM (SELECT user_id AS agent, max(CASE WHEN event_type = 'error' THEN ts END) AS err, min(ts) AS moment FROM events GROUP BY 1) WHERE err IS NULL OR err < TIMESTAMP '2100-01-01'")
def gossip_oldest(spark, d):
    rows = t.table(spark, d, "events").groupBy(F.col("user_id").alias("agent")).agg(F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("err"), F.min("ts").alias("moment"))
    return rows.where("err is null or err < timestamp_ntz '2100-01-01 00:00:00'").agg(F.min_by("agent", F.struct("moment", "agent")).alias("agent"))


@query("upsert_newer", "SELECT c.c_custkey AS agent, c.c_acctbal AS stamp FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = c.c_custkey AND s.s_acctbal >= c.c_acctbal)")
def upsert_newer(spark, d):
    old = t.table(spark, d, "supplier").select(F.col("s_suppkey").alias("agent"), F.col("s_acctbal").alias("stamp"))
    new = t.table(spark, d, "customer").select(F.col("c_custkey").alias("agent"), F.col("c_acctbal").alias("stamp"))
    return ch.newest_only(old, new, "agent", "stamp")


LOC = "SELECT event_id AS hash, ts, (event_id * 37) % 1000 AS loc FROM events"


def ring(name: str, start: int, end: int, where: str) -> None:
    @query(name, f"SELECT hash, loc FROM ({LOC}) WHERE {where}")
    def run(spark, d):
        return ch.ring(t.table(spark, d, "events").select(F.col("event_id").alias("hash"), (F.col("event_id") * 37 % 1000).alias("loc")), start, end)


ring("dht_range_single", 100, 250, "loc BETWEEN 100 AND 250")
ring("dht_range_full", 0, 999, "true")
ring("wrap_union_all", 900, 50, "loc >= 900 OR loc <= 50")


@query("gossip_query", f"SELECT hash, loc FROM ({LOC}) WHERE hash BETWEEN 100 AND 600 AND (loc BETWEEN 10 AND 90 OR loc BETWEEN 500 AND 520)")
def gossip_query(spark, d):
    rows = t.table(spark, d, "events").select(F.col("event_id").alias("hash"), (F.col("event_id") * 37 % 1000).alias("loc"))
    return rows.where("hash between 100 and 600 and (loc between 10 and 90 or loc between 500 and 520)")


WIKI = "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'src' || (c_custkey % 5) || '/en/' || c_custkey || '.md' WHEN 1 THEN 'src' || (c_custkey % 5) || '/en/' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS link FROM customer"


@query("resolve_wikilink", f"""WITH n AS ({t.NOTES_SQL}) SELECT id, link, coalesce((SELECT path FROM n WHERE path = link), (SELECT path FROM n WHERE path = link || '.md'), (SELECT min(path) FROM n WHERE CAST(doc_id AS VARCHAR) = regexp_extract(link, '([^/]*?)(\\.md)?$', 1))) AS path FROM ({WIKI})""")
def resolve_wikilink(spark, d):
    from ..operators import vault

    c = t.table(spark, d, "customer")
    link = F.expr("case c_custkey % 3 when 0 then 'src' || (c_custkey % 5) || '/en/' || c_custkey || '.md' when 1 then 'src' || (c_custkey % 5) || '/en/' || c_custkey else string(c_custkey) end")
    return vault.resolve(c.select(F.col("c_custkey").alias("id"), link.alias("link")), t.notes(spark, d).select("path")).select("id", "link", "path")


@query("exists_cond", "SELECT 'nation:' || n_nationkey AS subject FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey)")
def exists_cond(spark, d):
    rows = t.triples(spark, d)
    some = g.find(rows, predicate="in_nation").where("subject like 'supplier:%'").select(F.col("node").alias("subject"))
    return g.find(rows, predicate="in_region").join(some, "subject", "left_semi").select("subject")


@query("not_exists_cond", "SELECT 'customer:' || c_custkey AS subject FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists_cond(spark, d):
    find = lambda predicate, obj=None: g.find(t.triples(spark, d, predicate=predicate, obj=obj), predicate=predicate, obj=obj)
    pending = find("status", {"kind": "String", "str": "P"}).select(F.col("subject").alias("order"))
    some = find("placed_by").select(F.col("subject").alias("order"), F.col("node").alias("subject")).join(pending, "order", "left_semi")
    return find("segment").join(some, "subject", "left_anti").select("subject")


PAIRS = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
 p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS cosine FROM v a JOIN v b ON a.id < b.id) """


def vectors(spark, d):
    return t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("cosine_pairs", PAIRS + "SELECT a, b, cosine FROM p WHERE cosine >= 0.4")
def cosine_pairs(spark, d):
    return sim.similar_pairs(vectors(spark, d), 0.3999995).select("a", "b", F.round("cosine", 6).alias("cosine")).where("cosine >= 0.4")


NAMES = "SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9\\s]', '', 'g')) AS name FROM part"


@query("fuzzy_names", f"WITH n AS ({NAMES}) SELECT a.name, b.name AS listed, round(1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE), 6) AS score FROM n a JOIN n b ON a.name < b.name WHERE 1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) >= 0.6")
def fuzzy_names(spark, d):
    names = t.table(spark, d, "part").select(sim.normalize_name(F.col("p_name")).alias("name")).distinct()
    found = sim.fuzzy_matches(names, names, 0.6, {"edit": sim.levenshtein_similarity})
    return found.where("name < listed").select("name", "listed", F.round("score", 6).alias("score"))


@query("jaro_winkler", "SELECT c_custkey AS id, round(jaro_winkler_similarity(lower(c_name), lower(c_mktsegment || c_name)), 6) AS score FROM customer")
def jaro_winkler(spark, d):
    c = t.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.round(sim.jaro_winkler(F.lower("c_name"), F.lower(F.concat("c_mktsegment", "c_name"))), 6).alias("score"))


LISTED = NAMES.replace("FROM part", "FROM part WHERE p_partkey % 50 = 0").replace("AS name", "AS listed")
LEV = "1 - levenshtein(name, listed) / CAST(greatest(length(name), length(listed)) AS DOUBLE)"


@query("sanctions_screen", f"SELECT name, listed, round(greatest({LEV}, jaro_winkler_similarity(name, listed)), 6) AS score FROM ({NAMES}) n, ({LISTED}) l WHERE greatest({LEV}, jaro_winkler_similarity(name, listed)) >= 0.85")
def sanctions_screen(spark, d):
    names = t.table(spark, d, "part").select(F.col("p_name").alias("name"))
    listed = t.table(spark, d, "part").where("p_partkey % 50 = 0").select(F.col("p_name").alias("name"))
    ways = {"edit": sim.levenshtein_similarity, "letters": sim.jaro_winkler}
    return sim.fuzzy_matches(names, listed, 0.85, ways).select("name", "listed", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "name", "listed")


@query("identifier_match", "SELECT c_custkey AS entity, s_suppkey AS listed, 1.0::DOUBLE AS confidence FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def identifier_match(spark, d):
    c, s = t.table(spark, d, "customer"), t.table(spark, d, "supplier")
    return c.join(s, (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).select(F.col("c_custkey").alias("entity"), F.col("s_suppkey").alias("listed"), F.lit(1.0).alias("confidence"))


@query("as_of_action", f"SELECT q.agent, q.id AS at, coalesce((SELECT max_by(p.id, struct_pack(t := p.ts, i := p.id)) FROM ({t.EVENTS_SQL}) p WHERE p.agent = q.agent AND p.event_type = 'purchase' AND (p.ts, p.id) <= (q.ts, q.id)), -1) AS action FROM ({t.EVENTS_SQL}) q WHERE q.event_type = 'error'")
def as_of_action(spark, d):
    e = t.trace_events(spark, d)
    return traces.as_of(e.where("event_type = 'error'"), e.where("event_type = 'purchase'")).select("agent", F.col("id").alias("at"), F.coalesce("action", F.lit(-1)).alias("action"))


@query("receipts_list", H + "SELECT base, count(*) AS receipts FROM h WHERE state = 'F' GROUP BY 1")
def receipts_list(spark, d):
    return t.headers(spark, d).where("state = 'F'").groupBy("base").agg(F.count(F.lit(1)).alias("receipts"))


@query("receipts_add", H + "SELECT base, hash FROM h WHERE state = 'F' AND quantity = 50 UNION SELECT base, hash FROM h WHERE state = 'F' AND quantity >= 49")
def receipts_add(spark, d):
    h = t.headers(spark, d).where("state = 'F'")
    return ch.add_receipts(h.where("quantity = 50").select("base", "hash"), h.where("quantity >= 49").select("base", "hash"), ["base", "hash"])


@query("merkle_root")
def merkle_root(spark, d):
    """The root over the customers' names in order of their keys."""
    c = t.table(spark, d, "customer").select((F.col("c_custkey") - 1).alias("at"), F.sha2("c_name", 256).alias("hash"))
    return ch.merkle_levels(c)[-1].select("hash")
