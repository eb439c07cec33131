"""Notes: link resolution, degrees, backlinks, map and local graph, tasks and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY_POINTS, VIEW_NODES, SEMANTIC_EDGES, PEERS, BEST = 20, 600, 1200, 6, 3


def basename(path: Column) -> Column:
    """What is behind the last slash, without its last extension."""
    return F.regexp_extract(path, r"([^/\\]*?)(?:\.[^./\\]*)?$", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./\\]*$", "")


def strip_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"^<|>$", "")


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links(link) with path: the note of exactly that path, else of that path without extension, else the first of that basename."""
    exact = notes.select(F.col("path").alias("link"), F.col("path").alias("p1"))
    bare = notes.groupBy(without_extension(F.col("path")).alias("link")).agg(F.min("path").alias("p2"))
    base = notes.groupBy(basename(F.col("path")).alias("base")).agg(F.min("path").alias("p3"))
    out = links.join(exact, "link", "left").join(bare, "link", "left").withColumn("base", basename(F.col("link"))).join(base, "base", "left")
    return out.withColumn("path", F.coalesce("p1", "p2", "p3")).drop("p1", "p2", "p3", "base")


def stale_facts(stored: DataFrame, produced: DataFrame, notes: DataFrame) -> DataFrame:
    """Stored facts of these notes that are no longer produced."""
    return stored.join(notes.select("note"), "note", "left_semi").join(produced.select("note", "subject", "predicate", "str"), ["note", "subject", "predicate", "str"], "left_anti")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, n_in, n_out of every node: one aggregation over both ends of every link."""
    ends = links.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(links.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    every = ends.unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return every.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def entry_points(degree: DataFrame) -> DataFrame:
    return degree.where("n_in + n_out > 0").orderBy(F.desc("n_in"), F.desc("n_out"), "id").limit(ENTRY_POINTS)


def orphans(degree: DataFrame) -> DataFrame:
    return degree.where("n_in = 0 and n_out = 0")


def view_nodes(degree: DataFrame) -> DataFrame:
    return degree.select("id", (F.col("n_in") + F.col("n_out")).alias("degree")).orderBy(F.desc("degree"), "id").limit(VIEW_NODES)


def folders(paths: DataFrame) -> DataFrame:
    """Every folder above every file, once."""
    parts = F.split("path", "/")
    return paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()


def backlinks(links: DataFrame, target: int) -> DataFrame:
    return links.where(F.col("dst") == target).select("src")


def mention_lines(text: Column, word: str, most: int = 200) -> Column:
    """The first line that mentions the word, cut to `most` characters."""
    return F.substring(F.get(F.filter(F.split(text, "\n"), lambda x: mentions(x, word)), 0), 1, most)


def mentions(text: Column, word: str) -> Column:
    """Whether the word stands in the text, in any case, not within a longer word."""
    import re

    return text.rlike(r"(?i)(?<![\p{L}\p{N}])" + re.escape(word) + r"(?![\p{L}\p{N}])")


def top_per_node(pairs: DataFrame, k: int = BEST) -> DataFrame:
    """The pairs (a, b, cosine) that either end has among its k best."""
    ends = pairs.select(F.col("a").alias("node"), "a", "b", "cosine").unionByName(pairs.select(F.col("b").alias("node"), "a", "b", "cosine"))
    best = ends.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "a", "b"))).where(F.col("n") <= k)
    return best.select("a", "b", "cosine").distinct()


def tag_peers(tagged: DataFrame, k: int = PEERS) -> DataFrame:
    """note, tag, peer: the first k other notes of each of a note's tags.

    The first k + 1 notes of a tag hold every note's first k peers, so a tag that all notes bear
    costs a top-k, and notes meet k + 1 rows, not all.
    """
    first = tagged.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy("note"))).where(F.col("n") <= k + 1).select("tag", F.col("note").alias("peer"))
    rows = tagged.join(first, "tag").where("note <> peer")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("note", "tag").orderBy("peer"))).where(F.col("n") <= k).select("note", "tag", "peer")


def local_graph(links: DataFrame, start: int, depth: int = 2, frontier: int = 16, nodes: int = 80) -> DataFrame:
    """src, dst of the undirected surroundings of a note: at most `frontier` notes (by id) grow at each step, `nodes` are kept."""
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen, grow, edges = {start}, [start], None
    for _ in range(depth):
        step = both.where(F.col("src").isin(grow)).select("src", "dst").distinct()
        edges = step if edges is None else edges.unionByName(step)
        # the frontier is bounded by the operator itself
        found = [r["dst"] for r in step.where(~F.col("dst").isin(list(seen))).select("dst").distinct().orderBy("dst").limit(frontier).collect()]
        seen.update(found)
        grow = found
        if not grow:
            break
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    kept = ends.orderBy(F.desc(F.col("id") == start), F.desc("degree"), "id").limit(nodes).select("id")
    return pairs.join(F.broadcast(kept.withColumnRenamed("id", "a")), "a", "left_semi").join(F.broadcast(kept.withColumnRenamed("id", "b")), "b", "left_semi")


# --- tasks and cards -------------------------------------------------------------------------------

#: Ranks of priorities.
PRIORITY = {"high": 0, "medium": 1, "low": 2}
#: The mark of a checkbox, or the word that begins a line, and the status that each stands for; other words are open.
BOXES = {"x": "done", "X": "done", "/": "doing", "-": "canceled", " ": "todo"}
KEYWORDS = {"DONE": "done", "DOING": "doing", "NOW": "doing", "IN-PROGRESS": "doing", "CANCELED": "canceled", "CANCELLED": "canceled"}
OPEN_WORDS = ("TODO", "LATER", "WAITING", "WAIT")
#: The signs before a deadline, a scheduled date and a recurrence, and the letters of its units.
DUE, SCHEDULED, AGAIN, UNITS = "\U0001f4c5", "\u23f3", "\U0001f501", {"day": "d", "week": "w", "month": "m", "year": "y"}
_DATE = r"\s*(\d{4}-\d{2}-\d{2})"
_VALID = r"\s*\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_BOX = r"^\s*[-*+]\s+\[([ xX/\-])\](?:\s+(.*))?$"
_WORD = r"^\s*(?:[-*+]\s+)?(" + "|".join(sorted([*KEYWORDS, *OPEN_WORDS], key=lambda w: (-len(w), w))) + r")\s+(.*)$"
_RECUR = "(?i)" + AGAIN + r"\s*(?:every\s+)?(?:(\d+)\s+)?(day|week|month|year)s?"


def valid_date(text: Column) -> Column:
    month, day = F.substring(text, 6, 2).try_cast("int"), F.substring(text, 9, 2).try_cast("int")
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & month.between(1, 12) & day.between(1, 31), F.lit(False))


def _lookup(key: Column, values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def parse_task(line: Column) -> Column:
    """status, text, priority, due, scheduled, recurrence of a checkbox line or one that begins with a keyword; null for other lines.

    A date that can't be stays in the text and counts as none; a recurrence is a number and a unit's letter (3d).
    """
    box = line.rlike(_BOX)
    body = F.when(box, F.regexp_extract(line, _BOX, 2)).otherwise(F.regexp_extract(line, _WORD, 2))
    status = F.when(box, _lookup(F.regexp_extract(line, _BOX, 1), BOXES, "todo")).otherwise(_lookup(F.regexp_extract(line, _WORD, 1), KEYWORDS, "todo"))
    date = lambda sign: F.nullif(F.regexp_extract(body, sign + _DATE, 1), F.lit(""))
    due, scheduled = date(DUE), date(SCHEDULED)
    letter = F.regexp_extract(body, r"\[#([ABC])\]", 1)
    text = F.regexp_replace(body, rf"\[#[ABC]\]|(?:{DUE}|{SCHEDULED}){_VALID}", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, _RECUR, ""), r"\s+", " "))
    count = F.coalesce(F.greatest(F.regexp_extract(body, _RECUR, 1).try_cast("int"), F.lit(1)), F.lit(1))
    return F.when(
        box | line.rlike(_WORD),
        F.struct(
            status.alias("status"),
            text.alias("text"),
            F.when(letter == "A", "high").when(letter == "B", "medium").when(letter == "C", "low").otherwise("none").alias("priority"),
            F.when(valid_date(due), due).alias("due"),
            F.when(valid_date(scheduled), scheduled).alias("scheduled"),
            F.when(body.rlike(_RECUR), F.concat(count.cast("string"), _lookup(F.lower(F.regexp_extract(body, _RECUR, 2)), UNITS, "y"))).alias("recurrence"),
        ),
    )


def task_order() -> list[Column]:
    rank = F.lit(3)
    for p, r in PRIORITY.items():
        rank = F.when(F.col("priority") == p, r).otherwise(rank)
    return [F.coalesce("due", F.lit("~")), rank, F.col("text")]


def agenda(tasks: DataFrame, today: str, days: int) -> DataFrame:
    """Open tasks that are overdue, due today or within the days, by the earlier of deadline and schedule."""
    when_ = F.least(F.coalesce("due", F.lit("9999-12-31")), F.coalesce("scheduled", F.lit("9999-12-31")))
    until = F.date_add(F.lit(today).cast("date"), days).cast("string")
    bucket = F.when(when_ < today, "overdue").when(when_ == today, "today").when(when_ <= until, "upcoming")
    return tasks.where(F.col("status").isin("todo", "doing")).withColumn("bucket", bucket).where("bucket is not null")


def card_status(due: Column, today: str) -> Column:
    return F.when(due.isNull(), "new").when(due <= today, "due").otherwise("scheduled")


def cloze(text: Column) -> Column:
    """The hidden parts of {{cloze ...}}."""
    return F.regexp_extract_all(text, F.lit(r"\{\{cloze (.*?)\}\}"), 1)


_CARD, _SRS = r"(?:^|\s)#card($|[^A-Za-z0-9_/-])", r"(?s)<!--\s*srs\b(.*?)-->\s*$"


def parse_card(line: Column) -> Column:
    """front, clozes (answer, hint), id, ef, int, reps, due, last, q of a card line; null for other lines.

    A card has the tag #card or a cloze; a cloze's hint stands behind its last two backslashes. The state of
    its reviews is a comment at the line's end, <!-- srs key=value ... -->, of which malformed values count as missing.
    """
    inner = F.regexp_extract_all(line, F.lit(r"\{\{cloze\s+(.*?)\}\}"), 1)

    def cloze_of(x: Column) -> Column:
        parts = F.split(x, r"\\\\")
        answer = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), r"\\")).otherwise(x)
        return F.struct(F.trim(answer).alias("answer"), F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -1))).alias("hint"))

    tokens = F.split(F.regexp_extract(line, _SRS, 1), r"\s+")

    def value(key: str) -> Column:
        own = F.filter(tokens, lambda x: x.startswith(key + "="))
        return F.when(F.size(own) > 0, F.substring(F.element_at(own, -1), len(key) + 2, 1 << 20))

    number = lambda key: F.when(value(key).rlike(r"^[+-]?\d+$"), value(key)).alias(key)
    date = lambda key: F.when(valid_date(value(key)), value(key)).alias(key)
    front = F.regexp_replace(F.regexp_replace(line, _SRS, ""), _CARD, " $1")
    return F.when(
        line.rlike(_CARD) | (F.size(inner) > 0),
        F.struct(
            F.trim(F.regexp_replace(front, r"\s+", " ")).alias("front"),
            F.transform(inner, cloze_of).alias("clozes"),
            F.when(value("id").rlike("^[0-9a-f]{12}$"), value("id")).alias("id"),
            F.when(value("ef").try_cast("double").isNotNull(), value("ef")).alias("ef"),
            number("int"),
            number("reps"),
            date("due"),
            date("last"),
            number("q"),
        ),
    )


def wikilinks(line: Column) -> Column:
    """Targets of [[target|alias]] and [[target]]."""
    return F.transform(F.regexp_extract_all(line, F.lit(r"\[\[([^\]\|#]+)[^\]]*\]\]"), 1), lambda x: F.trim(x))


def inline_tags(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), 1)


def unfenced_lines(notes: DataFrame) -> DataFrame:
    """path, n, line of lines outside fenced code; the fence's state is a fold over a note's lines."""
    rows = notes.select("path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    before = F.sum(fence.cast("int")).over(Window.partitionBy("path").orderBy("n"))
    return rows.withColumn("open", before % 2 == 1).where(~F.col("open") & ~fence).drop("open")


def frontmatter_tags(content: Column) -> Column:
    head = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---", 1)
    inline = F.regexp_extract(head, r"(?m)^tags:\s*\[(.*?)\]", 1)
    return F.filter(F.transform(F.split(inline, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def _with_tags(content: Column, tags: Column) -> Column:
    """content with the list of tags in its front matter, which is made if there is none."""
    line = F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]"))
    has_head, has_tags = content.rlike(r"(?s)^---\n.*?\n---"), F.regexp_extract(content, r"(?s)^---\n(.*?)\n---", 1).rlike(r"(?m)^tags:\s*\[")
    head, rest = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---(.*)$", 1), F.regexp_extract(content, r"(?s)^---\n(.*?)\n---(.*)$", 2)
    parts = F.split(head, "\n")
    lines = F.when(has_tags, F.transform(parts, lambda x: F.when(x.rlike(r"^tags:\s*\["), line).otherwise(x))).otherwise(F.concat(parts, F.array(line)))
    return F.when(has_head, F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---"), rest)).otherwise(F.concat(F.lit("---\n"), line, F.lit("\n---\n"), content))


def add_tag(content: Column, tag: str) -> Column:
    """A note with one tag more in its front matter; as it is if it has it."""
    tags = frontmatter_tags(content)
    return F.when(F.array_contains(tags, tag.lower()), content).otherwise(_with_tags(content, F.concat(tags, F.array(F.lit(tag.lower())))))


def remove_tag(content: Column, tag: str) -> Column:
    tags = frontmatter_tags(content)
    return F.when(F.array_contains(tags, tag.lower()), _with_tags(content, F.array_remove(tags, tag.lower()))).otherwise(content)


def edit_lines(content: Column, first: int, last: int, text: str) -> Column:
    """A note whose lines first to last (from 1) are the text instead."""
    lines = F.split(content, "\n")
    after = F.when(F.size(lines) > last, F.slice(lines, last + 1, F.greatest(F.size(lines) - last, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(lines, 1, first - 1), F.split(F.lit(text), "\n"), after), "\n")


def neutralize(text: Column) -> Column:
    """Markdown marks as plain characters."""
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|<>~])", r"\\$1")


def fixed_chunks(notes: DataFrame, lines: int = 50) -> DataFrame:
    """path, line_start, line_end, text: windows of `lines` lines."""
    rows = notes.select("path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    by = rows.groupBy("path", F.floor(F.col("n") / lines).cast("int").alias("w")).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("x"))
    return by.select("path", (F.col("w") * lines + 1).alias("line_start"), (F.col("w") * lines + F.size("x")).alias("line_end"), F.array_join("x.line", "\n").alias("text"))


def heading_chunks(notes: DataFrame) -> DataFrame:
    """path, line_start, heading, text: a chunk for each heading's section."""
    rows = notes.select("path", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    own = Window.partitionBy("path").orderBy("n")
    rows = rows.withColumn("section", F.sum(F.col("line").rlike("^#{1,6} ").cast("int")).over(own))
    by = rows.groupBy("path", "section").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("x"))
    return by.select("path", (F.col("x")[0]["n"] + 1).alias("line_start"), F.when(F.col("section") > 0, F.col("x")[0]["line"]).alias("heading"), F.array_join("x.line", "\n").alias("text"))
