"""SPARQL to DataFrames: a parser for the documented surface, an algebra, and a compiler.

A variable v becomes two columns: v (the bare text) and v__k (the kind of value). Patterns of a
group join on the variables they share, most bound first; OPTIONAL is a left join, UNION a bag
union by name, MINUS and NOT EXISTS anti joins, EXISTS a semi join. A FILTER that errs drops the row:
errors are nulls here, and a null condition is false.

compat=True keeps what an unfinished executor is known to return: patterns of a group are
concatenated instead of joined, and DISTINCT, ORDER BY, LIMIT and GROUP BY are not applied.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model

MOST_REGEX = 256
_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<num>[+-]?(?:\d+\.\d+|\d+))|(?P<lang>@[\w-]+)|(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!*/+\-])|(?P<name>[\w-]*:[\w.-]*\w|[\w-]*:|\w+)""")


@dataclass
class Term:
    kind: str  # var, iri, literal
    value: str
    datatype: str | None = None


@dataclass
class Query:
    form: str
    variables: list = field(default_factory=list)  # names, or (expression, name)
    where: list = field(default_factory=list)
    template: list = field(default_factory=list)
    distinct: bool = False
    group: list = field(default_factory=list)
    order: list = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


class Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not SPARQL at {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
        self.i, self.prefixes = 0, {}

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.i + ahead][1] if self.i + ahead < len(self.tokens) else ""

    def word(self) -> str:
        return self.peek().upper()

    def next(self) -> tuple[str, str]:
        self.i += 1
        return self.tokens[self.i - 1]

    def take(self, *words: str) -> bool:
        if self.word() in words:
            self.i += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ValueError(f"{word} was expected, not {self.peek()!r}")

    def query(self) -> Query:
        while self.take("PREFIX"):
            name = self.next()[1][:-1]
            self.prefixes[name] = self.next()[1][1:-1]
        q = Query(self.next()[1].upper())
        if q.form == "SELECT":
            q.distinct = self.take("DISTINCT")
            while self.word() not in ("WHERE", "{"):
                if self.take("*"):
                    continue
                if self.take("("):
                    e = self.expression()
                    self.need("AS")
                    q.variables.append((e, self.next()[1][1:]))
                    self.need(")")
                else:
                    q.variables.append(self.next()[1][1:])
        elif q.form == "CONSTRUCT":
            q.template = [x for x in self.group() if x[0] == "triple"]
        elif q.form == "DESCRIBE":
            while self.word() not in ("WHERE", "{", ""):
                q.variables.append(self.term())
        elif q.form != "ASK":
            raise ValueError(f"unknown form {q.form}")
        self.take("WHERE")
        if self.peek() == "{":
            q.where = self.group()
        if self.take("GROUP"):
            self.need("BY")
            while self.peek()[:1] == "?":
                q.group.append(self.next()[1][1:])
        if self.take("ORDER"):
            self.need("BY")
            while self.peek()[:1] == "?" or self.word() in ("ASC", "DESC"):
                down = self.word() == "DESC"
                if self.take("ASC", "DESC"):
                    self.need("(")
                    q.order.append((self.next()[1][1:], down))
                    self.need(")")
                else:
                    q.order.append((self.next()[1][1:], False))
        while self.word() in ("LIMIT", "OFFSET"):
            if self.next()[1].upper() == "LIMIT":
                q.limit = int(self.next()[1])
            else:
                q.offset = int(self.next()[1])
        if self.i < len(self.tokens):
            raise ValueError(f"unexpected {self.peek()!r}")
        return q

    def term(self) -> Term:
        kind, value = self.next()
        if kind == "var":
            return Term("var", value[1:])
        if kind == "iri":
            return Term("iri", value[1:-1])
        if kind == "num":
            return Term("literal", value, "number")
        if kind == "str":
            out = Term("literal", re.sub(r"\\(.)", r"\1", value[1:-1]))
            if self.i < len(self.tokens) and self.tokens[self.i][0] == "lang":
                out.datatype = self.next()[1]
            elif self.take("^^"):
                out.datatype = self.term().value
            return out
        if value in ("true", "false"):
            return Term("literal", value, "boolean")
        if value == "a":
            return Term("iri", "rdf:type")
        prefix, colon, local = value.partition(":")
        if colon:
            return Term("iri", self.prefixes[prefix] + local if prefix in self.prefixes else value)
        raise ValueError(f"a term was expected, not {value!r}")

    def group(self) -> list:
        self.need("{")
        out: list = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("FILTER"):
                negated = self.word() == "NOT" and self.peek(1).upper() == "EXISTS"
                if negated:
                    self.i += 1
                if self.take("EXISTS"):
                    out.append(("not exists" if negated else "exists", self.group()))
                else:
                    out.append(("filter", self.expression()))
            elif self.take("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.take("MINUS"):
                out.append(("minus", self.group()))
            elif self.take("BIND"):
                self.need("(")
                e = self.expression()
                self.need("AS")
                out.append(("bind", e, self.next()[1][1:]))
                self.need(")")
            elif self.take("VALUES"):
                name = self.next()[1][1:]
                self.need("{")
                values = []
                while not self.take("}"):
                    values.append(self.term())
                out.append(("values", name, values))
            elif self.peek() == "{":
                sides = [self.group()]
                while self.take("UNION"):
                    sides.append(self.group())
                out.append(("union", sides) if len(sides) > 1 else ("group", sides[0]))
            else:
                subject = self.term()
                while True:
                    predicate = self.term()
                    while True:
                        out.append(("triple", subject, predicate, self.term()))
                        if not self.take(","):
                            break
                    if not self.take(";") or self.peek() in (".", "}"):
                        break
        return out

    def expression(self, level: int = 0):
        ops = (("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/"))
        if level == len(ops):
            return self.unary()
        left = self.expression(level + 1)
        while self.peek() in ops[level]:
            op = self.next()[1]
            left = ("op", op, left, self.expression(level + 1))
        return left

    def unary(self):
        if self.take("!"):
            return ("not", self.unary())
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        kind, value = self.tokens[self.i]
        if kind == "name" and self.peek(1) == "(":
            self.i += 2
            args, distinct = [], self.take("DISTINCT")
            while not self.take(")"):
                if self.take("*"):
                    args.append("*")
                elif not self.take(","):
                    args.append(self.expression())
            return ("call", value.upper(), args, distinct)
        return ("term", self.term())


def parse(text: str) -> Query:
    return Parser(text).query()


# --- compiler ------------------------------------------------------------------------------------

Value = tuple[Column, Column]
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}


def _number(v: Value) -> Column:
    return v[0].try_cast("double")


class Compiler:
    def __init__(self, triples: DataFrame, compat: bool = False):
        self.triples, self.compat = triples, compat

    # expressions

    def value(self, e, columns: set[str]) -> Value:
        kind = e[0]
        if kind == "term":
            t = e[1]
            if t.kind == "var":
                return (F.col(t.value), F.col(t.value + "__k")) if t.value in columns else (F.lit(None).cast("string"), F.lit(None).cast("string"))
            return F.lit(t.value), F.lit("Node" if t.kind == "iri" else {"number": "Float", "boolean": "Boolean"}.get(t.datatype, "String"))
        if kind == "op" and e[1] in "+-*/":
            a, b = _number(self.value(e[2], columns)), _number(self.value(e[3], columns))
            out = {"+": a + b, "-": a - b, "*": a * b, "/": a / F.nullif(b, F.lit(0.0))}[e[1]]
            return out.cast("string"), F.lit("Float")
        if kind == "call":
            name, args = e[1], e[2]
            if name in ("STR", "UCASE", "LCASE", "STRLEN", "LANG", "CONCAT"):
                parts = [self.value(a, columns)[0] for a in args]
                if name == "LANG":
                    v = args[0][1].value
                    return F.coalesce(F.col(v + "__l"), F.lit("")) if v + "__l" in columns else F.lit(""), F.lit("String")
                out = {"STR": lambda: parts[0], "UCASE": lambda: F.upper(parts[0]), "LCASE": lambda: F.lower(parts[0]), "STRLEN": lambda: F.length(parts[0]).cast("string"), "CONCAT": lambda: F.concat(*parts)}[name]()
                return out, F.lit("Integer" if name == "STRLEN" else "String")
        return self.condition(e, columns).cast("string"), F.lit("Boolean")

    def condition(self, e, columns: set[str]) -> Column:
        kind = e[0]
        if kind == "not":
            return ~self.condition(e[1], columns)
        if kind == "op" and e[1] in ("&&", "||"):
            a, b = self.condition(e[2], columns), self.condition(e[3], columns)
            return a & b if e[1] == "&&" else a | b
        if kind == "op" and e[1] in ("=", "!=", "<", ">", "<=", ">="):
            a, b = self.value(e[2], columns), self.value(e[3], columns)
            x, y = _number(a), _number(b)
            if e[1] in ("=", "!="):
                same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a[0] == b[0])
                return same if e[1] == "=" else ~same
            # an order of other than numbers is no order: the row goes
            return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[e[1]]
        if kind == "call":
            name, args = e[1], e[2]
            if name == "BOUND":
                v = args[0][1].value
                return F.col(v).isNotNull() if v in columns else F.lit(False)
            text, what = self.value(args[0], columns)
            if name == "REGEX":
                pattern = args[1][1].value
                if len(pattern) > MOST_REGEX:
                    raise ValueError("the pattern is too long")
                return text.rlike(("(?i)" if len(args) > 2 and "i" in args[2][1].value else "") + pattern)
            if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
                other = self.value(args[1], columns)[0]
                return {"CONTAINS": text.contains, "STRSTARTS": text.startswith, "STRENDS": text.endswith}[name](other)
            if name in ("ISIRI", "ISURI"):
                return what == "Node"
            if name == "ISBLANK":
                return what == "Blank"
            if name == "ISLITERAL":
                return ~what.isin("Node", "Blank")
            if name == "ISNUMERIC":
                return what.isin("Integer", "Float")
            if name == "LANGMATCHES":
                wanted = args[1][1].value.lower()
                return (text != "") if wanted == "*" else (F.lower(text) == wanted) | F.lower(text).startswith(wanted + "-")
            raise ValueError(f"unknown function {name}")
        return self.value(e, columns)[0].cast("boolean")

    # patterns

    def triple(self, subject: Term, predicate: Term, obj: Term) -> DataFrame:
        rows, picked, seen = self.triples, [], {}
        for t, text, kind, lang in (
            (subject, F.col("subject"), F.when(F.col("subject_kind") == "blank", "Blank").otherwise("Node"), None),
            (predicate, F.col("predicate"), F.lit("Node"), None),
            (obj, model.value_text(), F.col("kind"), F.col("lang")),
        ):
            if t.kind == "var":
                if t.value in seen:
                    rows = rows.where(seen[t.value] == text)
                    continue
                seen[t.value] = text
                picked += [text.alias(t.value), kind.alias(t.value + "__k")]
            elif t is subject:
                rows = rows.where(F.col("subject") == t.value)
            elif t is predicate:
                rows = rows.where(F.col("predicate") == t.value)
            elif t.kind == "iri":
                rows = rows.where((F.col("kind") == "Node") & (F.col("node") == t.value))
            elif t.datatype == "number":
                rows = rows.where(F.coalesce(F.col("dbl"), F.col("int").cast("double")) == float(t.value))
            else:
                rows = rows.where((F.col("kind") != "Node") & (model.value_text() == t.value))
        return rows.select(*picked) if picked else rows.select(F.lit(1).alias("__one"))

    @staticmethod
    def variables(df: DataFrame) -> set[str]:
        return {c for c in df.columns if not c.endswith("__k")}

    def join(self, left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        shared = sorted((self.variables(left) & self.variables(right)) - {"__one"})
        right = right.drop(*[s + "__k" for s in shared]) if how in ("inner", "left") else right.select(*shared)
        if "__one" in left.columns and "__one" in right.columns:
            right = right.drop("__one") if len(right.columns) > 1 else right.withColumnRenamed("__one", "__two")
        if shared:
            out = left.join(right, shared, how)
        elif how in ("inner", "left"):
            out = left.join(right, F.lit(True), how)  # a query without shared variables asks for every combination
        else:
            return left if how == "left_anti" else left.where(~F.lit(right.isEmpty()))
        return out.drop("__two")

    def group(self, items: list) -> DataFrame | None:
        patterns = [x for x in items if x[0] == "triple"]
        bound = lambda x: -sum(t.kind != "var" for t in x[1:])
        out: DataFrame | None = None
        if self.compat and len(patterns) > 1:
            out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.triple(*x[1:]) for x in patterns])
        else:
            left = sorted(patterns, key=bound)
            known: set[str] = set()
            while left:  # the most bound first, then what is tied to it
                names = lambda x: {t.value for t in x[1:] if t.kind == "var"}
                pick = next((x for x in left if names(x) & known), left[0])
                left.remove(pick)
                known |= names(pick)
                rows = self.triple(*pick[1:])
                out = rows if out is None else self.join(out, rows)
        filters = []
        for item in items:
            kind = item[0]
            if kind == "filter":
                filters.append(item[1])
            elif kind in ("group", "union"):
                sides = [self.group(x) for x in (item[1] if kind == "union" else [item[1]])]
                rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
                out = rows if out is None else self.join(out, rows)
            elif kind == "optional":
                inner = [x for x in item[1] if x[0] != "filter"]
                rows = self.group(inner)
                for x in item[1]:
                    if x[0] == "filter":
                        rows = rows.where(self.condition(x[1], set(rows.columns)))
                out = rows if out is None else self.join(out, rows, "left")
            elif kind in ("minus", "not exists", "exists"):
                rows = self.group(item[1])
                out = self.join(out, rows, "left_semi" if kind == "exists" else "left_anti")
            elif kind == "bind":
                text, what = self.value(item[1], set(out.columns))
                out = out.withColumns({item[2]: text, item[2] + "__k": what})
            elif kind == "values":
                rows = [(t.value, "Node" if t.kind == "iri" else "String") for t in item[2]]
                table = self.triples.sparkSession.createDataFrame(rows, f"`{item[1]}` string, `{item[1]}__k` string")
                out = table if out is None else self.join(out, table)
        for e in filters:
            out = out.where(self.condition(e, set(out.columns)))
        return out

    def aggregate(self, e, columns: set[str]) -> Column:
        _, name, args, distinct = e
        if args == ["*"]:
            return F.count(F.lit(1))
        text, what = self.value(args[0], columns)
        if name == "COUNT":
            return F.count_distinct(text) if distinct else F.count(text)
        number = text.try_cast("double")
        return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](number)

    def run(self, q: Query) -> DataFrame:
        if q.form == "DESCRIBE":
            names = [t.value for t in q.variables if t.kind == "iri"]
            if self.compat or not names and not q.where:
                return self.triples
            if q.where:
                rows = self.group(q.where)
                subjects = reduce(DataFrame.union, [rows.select(F.col(t.value).alias("subject")) for t in q.variables if t.kind == "var"]).distinct()
                return self.triples.join(subjects, "subject", "left_semi")
            return self.triples.where(F.col("subject").isin(names))
        rows = self.group(q.where)
        if q.form == "ASK":
            return rows.limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
        if q.form == "CONSTRUCT":
            text = lambda t: F.col(t.value) if t.kind == "var" else F.lit(t.value)
            made = [rows.select(text(s).alias("subject"), text(p).alias("predicate"), text(o).alias("object")) for _, s, p, o in q.template]
            return reduce(DataFrame.unionByName, made).where("subject is not null and predicate is not null and object is not null").distinct()
        columns = set(rows.columns)
        has_aggregate = any(isinstance(v, tuple) and v[0][0] == "call" and v[0][1] in AGGREGATES for v in q.variables)
        if (q.group or has_aggregate) and not self.compat:
            made = [self.aggregate(v[0], columns).alias(v[1]) for v in q.variables if isinstance(v, tuple)]
            rows = rows.groupBy(*q.group).agg(*made) if made else rows.select(*q.group).distinct()
            names = [v if isinstance(v, str) else v[1] for v in q.variables]
        else:
            for v in q.variables:
                if isinstance(v, tuple):
                    rows = rows.withColumn(v[1], self.value(v[0], columns)[0])
            names = [v if isinstance(v, str) else v[1] for v in q.variables] or sorted(self.variables(rows) - {"__one"})
            rows = rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in names], *[n + "__k" for n in [o for o, _ in q.order] if n + "__k" in rows.columns and n not in names], *[o for o, _ in q.order if o in rows.columns and o not in names])
        if self.compat:
            return rows.select(*names)
        if q.distinct:
            rows = rows.select(*names).distinct()
        if q.order:
            keys = []
            for n, down in q.order:
                for k in (F.col(n).cast("string").try_cast("double"), F.col(n).cast("string")):
                    keys.append(k.desc_nulls_last() if down else k.asc_nulls_first())
            rows = rows.orderBy(*keys)
        if q.offset:
            rows = rows.offset(q.offset)
        if q.limit is not None:
            rows = rows.limit(q.limit)
        return rows.select(*names)


def sparql(triples: DataFrame, text: str, compat: bool = False) -> DataFrame:
    return Compiler(triples, compat).run(parse(text))
