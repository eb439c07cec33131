"""Rules over triples: integrity checks as columns, inference as joins to a fixpoint, proofs, policies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import counted, fixpoint, ranks, store

#: Predicates that exclude each other.
OPPOSED = (("is", "is_not"), ("has", "lacks"), ("true", "false"), ("alive", "dead"), ("exists", "not_exists"), ("enables", "disables"), ("allows", "forbids"), ("before", "after"))


def integrity() -> dict[str, Column]:
    """What rejects a triple, by rule."""
    return {
        "self_reference": (F.col("kind") == "Node") & (F.col("subject") == F.col("node")),
        "empty_predicate": F.trim("predicate") == "",
        "empty_subject": F.trim("subject") == "",
        "subject_whitespace": F.col("subject").rlike(r"\s"),
    }


#: Predicates that rules of each set look at and accept; they name what holds of a triple and reject nothing.
ACCEPTING = {
    "authority": ("owns", "grants_permission", "delegates_to"),
    "temporal": ("before", "created_at", "expires_at", "has_sequence"),
    "core": ("author", "seq", "prevAction", "entryHash", "agent"),
}


def accepted_by(obj: Column | None = None) -> Column:
    """The rule sets, sorted, that have an accepting rule for a triple's predicate; those of core look at its local name behind a colon.

    obj: the object's text; the role of an admin is a matter of authority.
    """
    admin = F.lit(False) if obj is None else F.coalesce((F.col("predicate") == "has_role") & (obj == "admin"), F.lit(False))
    name = lambda kind: F.when(F.contains(F.col("predicate"), F.lit(":")), F.substring_index("predicate", ":", -1)) if kind == "core" else F.col("predicate")
    return F.array_compact(F.array(*[F.when(name(kind).isin(*names) | (admin & F.lit(kind == "authority")), F.lit(kind)) for kind, names in sorted(ACCEPTING.items())]))


def check_manifest(assertions: DataFrame, predicates: list[str]) -> DataFrame:
    """namespace, predicate, outcome of assertions(namespace, predicate, require_proof): whether a proof that is asked for has a rule to come from.

    predicates: those that enabled rules are about; without any, nothing can be evaluated. A bare predicate is one of the namespace.
    """
    full = F.when(F.contains(F.col("predicate"), F.lit(":")), F.col("predicate")).otherwise(F.concat("namespace", F.lit(":"), "predicate"))
    known = F.lit("not_evaluated") if not predicates else F.when(full.isin(*predicates), "rule_matched").otherwise("no_matching_rule")
    return assertions.select("namespace", full.alias("predicate"), F.when(F.col("require_proof"), known).otherwise("not_required").alias("outcome"))


def validate(triples: DataFrame) -> DataFrame:
    """triples with rejections (names of the rules, sorted) and accepted."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in sorted(integrity().items())]))
    return triples.withColumn("rejections", found).withColumn("accepted", F.size("rejections") == 0)


def contradictions(facts: DataFrame, pairs=OPPOSED) -> DataFrame:
    """subject, object with two opposed predicates: each pair's two sides meet in one aggregation on (subject, object)."""
    number, side = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (a, b) in enumerate(pairs):
        number = F.when(F.col("p").isin(a, b), i).otherwise(number)
        side = F.when(F.col("p") == a, 1).when(F.col("p") == b, 2).otherwise(side)
    rows = facts.select("s", "o", number.alias("pair"), side.alias("side")).where("pair is not null")
    return rows.groupBy("s", "o", "pair").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select("s", "o").distinct()


def temporal_cycles(before: DataFrame) -> DataFrame:
    """a, b with a before b and b before a."""
    back = before.select(F.col("o").alias("s"), F.col("s").alias("o"))
    return before.where("s < o").join(back, ["s", "o"], "left_semi").select(F.col("s").alias("a"), F.col("o").alias("b")).distinct()


def disjoint_violations(types: DataFrame, disjoint: DataFrame) -> DataFrame:
    """s, t1, t2: subjects of two types that are declared disjoint."""
    one, two = types.select("s", F.col("t").alias("t1")), types.select("s", F.col("t").alias("t2"))
    return one.join(F.broadcast(disjoint), "t1").join(two, ["s", "t2"]).select("s", "t1", "t2").distinct()


@dataclass
class Rule:
    """name: body patterns (s, p, o) imply head; terms that begin with ? are variables.

    A term may be a function from a column to a condition; `when` is one of what is derived, as a struct of s, p and o.
    """

    name: str
    body: list[tuple[str, str, str]]
    head: tuple[str, str, str]
    priority: int = 0
    unequal: list[tuple[str, str]] = field(default_factory=list)
    when: Callable[[Column], Column] | None = None


#: The built-in semantic rules, with the bindings that make them derive something.
SEMANTIC = (
    Rule("knows_transitive", [("?a", "knows", "?b"), ("?b", "knows", "?c")], ("?a", "knows", "?c"), unequal=[("?a", "?c")]),
    Rule("married_symmetric", [("?a", "married_to", "?b")], ("?b", "married_to", "?a")),
    Rule("subclass_type", [("?x", "type", "?t"), ("?t", "subclass_of", "?u")], ("?x", "type", "?u")),
    Rule("parent_child", [("?a", "parent_of", "?b")], ("?b", "child_of", "?a")),
    Rule("siblings", [("?p", "parent_of", "?a"), ("?p", "parent_of", "?b")], ("?a", "sibling_of", "?b"), unequal=[("?a", "?b")]),
)


def matches(facts: DataFrame, rule: Rule, delta: DataFrame | None = None, spot: int = 0) -> DataFrame:
    """s, p, o of what a rule derives from facts(s, p, o); with delta, its pattern number `spot` is matched by the delta alone."""
    out: DataFrame | None = None
    # the delta goes first, so that joins start from the few new rows
    for i in sorted(range(len(rule.body)), key=lambda i: (i != spot, i)):
        pattern = rule.body[i]
        rows = facts if delta is None or i != spot else delta
        fixed = [F.col(column) == term for column, term in zip("spo", pattern) if isinstance(term, str) and not term.startswith("?")]
        names: dict[str, list[str]] = {}
        for column, term in zip("spo", pattern):
            if callable(term):
                fixed.append(term(F.col(column)))
            elif term.startswith("?"):
                names.setdefault(term[1:], []).append(column)
        for columns in names.values():
            fixed += [F.col(columns[0]) == F.col(x) for x in columns[1:]]
        for cond in fixed:
            rows = rows.where(cond)
        rows = rows.select(*[F.col(columns[0]).alias(name) for name, columns in names.items()])
        if out is None:
            out = rows
        else:
            shared = sorted(set(out.columns) & set(rows.columns))
            out = out.join(rows, shared) if shared else out.crossJoin(rows)
    for a, b in rule.unequal:
        out = out.where(F.col(a[1:]) != F.col(b[1:]))
    term = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
    out = out.select(term(rule.head[0]).alias("s"), term(rule.head[1]).alias("p"), term(rule.head[2]).alias("o"))
    return out if rule.when is None else out.where(rule.when(F.struct("s", "p", "o")))


def forward_chain(facts: DataFrame, rules=SEMANTIC, one_step: bool = False) -> DataFrame:
    """s, p, o, rule of the facts that the rules add, to a fixpoint (or from the base facts alone).

    Semi-naive: a round joins, for each pattern of a rule, the facts of the last round with all known ones.
    """
    base = store(facts.select("s", "p", "o").distinct())
    known, delta, derived, turn = base, None, None, 0
    heads = {r.head[1] for r in rules if not r.head[1].startswith("?")}
    while True:
        found = None
        for r in rules:
            for spot, pattern in enumerate(r.body):
                name = pattern[1]
                if delta is None and spot:
                    break
                if delta is not None and isinstance(name, str) and not name.startswith("?") and name not in heads and all(not x.head[1].startswith("?") for x in rules):
                    continue  # no rule makes such facts
                rows = matches(known, r, delta, spot).withColumn("rule", F.lit(r.name))
                found = rows if found is None else found.unionByName(rows)
        if found is None:
            break
        fresh, n = counted(found.groupBy("s", "p", "o").agg(F.min("rule").alias("rule")).join(known, ["s", "p", "o"], "left_anti"))
        derived = fresh if derived is None else derived.unionByName(fresh)
        if one_step or not n:
            break
        turn += 1
        delta = fresh.select("s", "p", "o")
        known = store(known.unionByName(delta)) if turn % 8 == 0 else known.unionByName(delta)
    return derived


def prove(facts: DataFrame, goal: tuple[str, str, str], rules=SEMANTIC) -> DataFrame:
    """proved, rule: whether a goal is a fact or follows; goals are asked of the forward closure of the rules that can reach it."""
    wanted, names = {goal[1]}, set()
    while True:
        more = {r.name for r in rules if r.head[1] in wanted} - names
        if not more:
            break
        names |= more
        wanted |= {p[1] for r in rules if r.name in more for p in r.body}
    own = facts.where(F.col("p").isin(sorted(wanted)))
    every = own.select("s", "p", "o", F.lit("fact").alias("rule")).unionByName(forward_chain(own, [r for r in rules if r.name in names]))
    hit = every.where((F.col("s") == goal[0]) & (F.col("p") == goal[1]) & (F.col("o") == goal[2]))
    return hit.agg((F.count(F.lit(1)) > 0).alias("proved"), F.min("rule").alias("rule"))


def condition(spec: tuple) -> Column:
    """A policy's condition on column value: ('above', x), ('below', x), ('range', a, b), ('equals', x), ('and', ...), ('or', ...), ('not', c), ('always',), ('never',)."""
    kind, *args = spec
    v = F.col("value")
    if kind in ("and", "or"):
        out = condition(args[0])
        for a in args[1:]:
            out = out & condition(a) if kind == "and" else out | condition(a)
        return out
    return {
        "above": lambda: v > args[0],
        "below": lambda: v < args[0],
        "range": lambda: v.between(args[0], args[1]),
        "equals": lambda: v == args[0],
        "not": lambda: ~condition(args[0]),
        "always": lambda: F.lit(True),
        "never": lambda: F.lit(False),
    }[kind]()


def decide(observations: DataFrame, policies: list[tuple[int, tuple, str]]) -> DataFrame:
    """observations with action: that of the matching rule of highest priority (of equal ones the first)."""
    action = F.lit(None).cast("string")
    for _, spec, name in sorted(policies, key=lambda p: p[0]):
        action = F.when(condition(spec), name).otherwise(action)
    return observations.withColumn("action", action)


def executable_goals(goals: DataFrame) -> DataFrame:
    """Open goals without an open child."""
    open_ = goals.where("not done")
    return open_.join(open_.select(F.col("parent").alias("id")).where("id is not null"), "id", "left_anti").select("id")


def goal_progress(goals: DataFrame) -> DataFrame:
    return goals.where("parent is not null").groupBy(F.col("parent").alias("id")).agg((F.sum("progress") / F.count(F.lit(1))).alias("progress"))


def goal_conflicts(goals: DataFrame) -> DataFrame:
    """a, b: the neighbours, by id, of those that share priority and deadline; groups meet in a window, not in all pairs."""
    own = Window.partitionBy("priority", "deadline").orderBy("id")
    return goals.withColumn("b", F.lead("id").over(own)).where("b is not null").select(F.col("id").alias("a"), "b")


def topological_order(goals: DataFrame, needs: DataFrame) -> DataFrame:
    """id, rank of goals(id): every goal ranks above all that it needs(goal, needs), by the longest way; an error if goals need each other."""
    return ranks(goals.select(F.col("id").alias("node")), needs.select(F.col("needs").alias("src"), F.col("goal").alias("dst"))).select(F.col("node").alias("id"), "rank")


def closure(edges: DataFrame) -> DataFrame:
    """a, b: everything that is reached over edges(s, o)."""
    step = store(edges.select("s", "o").distinct())
    seed = step.select(F.col("s").alias("a"), F.col("o").alias("b"))
    return fixpoint(seed, lambda delta, turn: delta.join(step, F.col("b") == F.col("s")).select("a", F.col("o").alias("b")), ["a", "b"])
