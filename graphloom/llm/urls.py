"""URL filter: rules, and for the rest the likelihood ratio of two character language models.

Accepted and rejected URLs (those that a rule allows or blocks) each train a smoothed
variable-order Markov model over characters: a context is kept, up to ORDER characters long,
if it makes at least SHARE of all characters, and P(c | context) backs off to the next
shorter context with weight BACKOFF. Both models share their contexts, so together they are one
automaton: a table from (context, character) to the next context and the log-likelihood
difference. A URL's score is the mean of these along its characters; it is allowed if
the score reaches a threshold calibrated on URLs that rules decide and that the models haven't seen (a quarter of
them, by a hash of the URL, so that repeated URLs are on one side): the point between the two means
that lies as many standard deviations from either. If that quarter lacks a class, all that rules decide calibrate.

Everything here is DataFrame expressions. Characters are counted by partial aggregation; the
automaton has at most ORDER / SHARE contexts of ALPHABET entries each, whatever the
input, and becomes a constant of the scoring expression.

Defined cases: a URL that is null or has no :// has empty host and path and no rule; where
neither rules nor scores decide (no characters, or no URL of either class to learn from)
the verdict is allow; repeated rows are judged each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: (action, host and path prefix) as the contract has them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Symbols 1 to 37; every other character is 0, the start of a URL 38. Digits count as 0.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0/.-_?=&#:%"
START = len(SYMBOLS) + 1
ALPHABET = START + 1
ORDER = 3
SHARE = 5e-4
BACKOFF = 8.0
#: One in so many of the URLs that rules decide calibrates the threshold.
HELD = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ://."""
    host = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null without one."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, action = F.when(fits, rule).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def codes(url: Column) -> Column:
    """The symbols of what follows :// (of the whole text without it)."""
    text = F.translate(F.coalesce(F.regexp_replace(url, r"(?s)^.*?://", ""), F.lit("")), _UPPER + "123456789", _LOWER + "0" * 9)
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.instr(F.lit(SYMBOLS), x))


def _grams(judged: DataFrame) -> DataFrame:
    """context (ORDER symbols as a number), symbol, accepted, rejected: counts over all URLs with a rule but for the held ones."""
    padded = F.concat(F.array_repeat(F.lit(START), ORDER), F.col("codes"))
    context = F.lit(0)
    for back in range(ORDER):
        context = context * ALPHABET + F.element_at(F.col("padded"), F.col("i") + 1 + back)
    rows = judged.where("action is not null and not held and size(codes) > 0").select("action", padded.alias("padded"), F.posexplode("codes").alias("i", "symbol"))
    return rows.groupBy(context.alias("context"), "symbol").agg(F.sum(F.when(F.col("action") == "allow", 1).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("action") == "block", 1).otherwise(0)).alias("rejected"))


def automaton(judged: DataFrame) -> DataFrame:
    """One row: step (array of the next context's number), gain (array of log-likelihood differences), first."""
    grams = c.materialize(_grams(judged), "url-grams")
    symbols = F.explode(F.sequence(F.lit(0), F.lit(ALPHABET - 1))).alias("symbol")
    everything = grams.agg(F.sum(F.col("accepted") + F.col("rejected")).alias("n"))
    levels: list[DataFrame] = []
    for order in range(ORDER + 1):
        own = (F.col("context") % (ALPHABET**order)).cast("long")
        counts = grams.groupBy(own.alias("context"), "symbol").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
        states = counts.groupBy("context").agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        if order:
            states = states.where(F.col("na") + F.col("nr") >= SHARE * everything.scalar())
        grid = states.select("context", "na", "nr", symbols)
        grid = grid.join(counts, ["context", "symbol"], "left").fillna(0, ["a", "r"])
        if order:
            shorter = levels[-1].select(F.col("context").alias("suffix"), "symbol", F.col("pa").alias("qa"), F.col("pr").alias("qr"))
            grid = grid.withColumn("suffix", F.col("context") % (ALPHABET ** (order - 1))).join(shorter, ["suffix", "symbol"])
        else:
            grid = grid.withColumns({"qa": F.lit(1 / ALPHABET), "qr": F.lit(1 / ALPHABET)})
        smooth = lambda n, total, prior: (F.col(n) + BACKOFF * F.col(prior)) / (F.col(total) + BACKOFF)
        levels.append(c.materialize(grid.select(F.lit(order).alias("ord"), "context", "symbol", smooth("a", "na", "qa").alias("pa"), smooth("r", "nr", "qr").alias("pr")), "url-level"))
    table = levels[0]
    for level in levels[1:]:
        table = table.unionByName(level)
    numbered = table.select("ord", "context").distinct().withColumn("id", F.row_number().over(Window.orderBy("ord", "context")) - 1)
    numbered = c.materialize(numbered, "url-contexts")
    moves = table
    for order in range(ORDER + 1):
        target = numbered.where(F.col("ord") == order).select(F.col("context").alias(f"t{order}"), F.col("id").alias(f"id{order}"))
        grown = F.when(F.col("ord") >= order - 1, (F.col("context") * ALPHABET + F.col("symbol")) % (ALPHABET**order))
        moves = moves.withColumn(f"t{order}", grown).join(target, f"t{order}", "left")
    step = F.coalesce(*[F.col(f"id{order}") for order in range(ORDER, -1, -1)])
    moves = moves.join(numbered, ["ord", "context"]).select((F.col("id") * ALPHABET + F.col("symbol")).alias("at"), step.alias("step"), F.log(F.col("pa") / F.col("pr")).alias("gain"))
    start = sum(START * ALPHABET**i for i in range(ORDER))
    begin = numbered.where((F.col("ord") == ORDER) & (F.col("context") == start)).agg(F.coalesce(F.max("id"), F.lit(0)).alias("first"))
    cells = F.sort_array(F.collect_list(F.struct("at", "step", "gain")))
    return c.materialize(moves.agg(cells.alias("cells")).select(F.col("cells.step").alias("step"), F.col("cells.gain").alias("gain"), begin.scalar().alias("first")), "url-model")


def score(judged: DataFrame, model: DataFrame) -> DataFrame:
    """judged with score: the mean log-likelihood difference per character; null without characters or model."""
    row = model.select(F.concat_ws(",", F.col("step").cast("array<string>")), F.concat_ws(",", F.col("gain").cast("array<string>")), "first").first()
    # bounded as the module says, and folded into one constant of the plan
    step, gain = F.split(F.lit(row[0]), ",").cast("array<int>"), F.split(F.lit(row[1]), ",").cast("array<double>")
    first = F.lit(row[2] or 0)
    cell = lambda acc, x: acc["at"] * ALPHABET + x
    begin = F.struct(first.cast("int").alias("at"), F.lit(0.0).alias("total"))
    run = F.aggregate(
        "codes",
        begin,
        lambda acc, x: F.struct(F.get(step, cell(acc, x)).alias("at"), (acc["total"] + F.get(gain, cell(acc, x))).alias("total")),
        lambda acc: acc["total"],
    )
    return judged.withColumn("score", F.when(F.size("codes") > 0, run / F.size("codes")))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every page; keeps the other columns out."""
    host, path = split_url(F.col("url"))
    held = F.pmod(F.xxhash64("url"), F.lit(HELD)) == 0
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), codes(F.col("url")).alias("codes"), held.alias("held"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    judged = c.materialize(parts.withColumns({"rule": rule, "action": action}), "urls")
    both = judged.where("action is not null and not held and size(codes) > 0").agg(F.count_distinct("action")).first()[0]
    if both < 2:
        scored = judged.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = c.materialize(score(judged, automaton(judged)).drop("codes"), "url-scores")
    of = lambda f, kind, some: f(F.when((F.col("action") == kind) & some, F.col("score")))
    cuts = []
    for some in (F.col("held"), F.lit(True)):  # null without a score of either class
        a, r = (of(F.avg, x, some) for x in ("allow", "block"))
        sa, sr = (of(F.stddev_pop, x, some) + 1e-9 for x in ("allow", "block"))
        cuts.append((a * sr + r * sa) / (sa + sr))
    cut = scored.agg(F.coalesce(*cuts, F.lit(0.0)).alias("cut")).scalar()
    by_model = F.when(F.col("score") < cut, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", by_model).alias("verdict"), "score")
