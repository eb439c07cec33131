"""N-Triples and Turtle, in and out.

N-Triples is one regular expression per line in the JVM. Turtle carries prefixes and bases from
statement to statement, so a document is parsed whole, by an Arrow batch function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
_LINE = r'^\s*(?:<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|_:(\S+?)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'
_ESCAPES = (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'))


def _escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for code, plain in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def _unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\\\"), F.lit("\x01"))
    for code, plain in _ESCAPES:
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.replace(out, F.lit("\x01"), F.lit("\\"))


def _subject() -> Column:
    return F.when(F.col("subject_kind") == "blank", F.concat(F.lit("_:b"), F.col("subject"))).otherwise(F.concat(F.lit("<"), F.col("subject"), F.lit(">")))


def _object() -> Column:
    typed = lambda text, name: F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{name}>'))
    quoted = F.concat(F.lit('"'), _escape(F.col("str")), F.lit('"'))
    return (
        F.when(F.col("kind") == "Node", F.concat(F.lit("<"), F.col("node"), F.lit(">")))
        .when(F.col("kind") == "Integer", typed(F.col("int").cast("string"), "integer"))
        .when(F.col("kind") == "Float", typed(F.col("dbl").cast("string"), "double"))
        .when(F.col("kind") == "Boolean", typed(F.col("bool").cast("string"), "boolean"))
        .when(F.col("kind") == "DateTime", typed(F.col("str"), "dateTime"))
        .when(F.col("kind") == "LangString", F.concat(quoted, F.lit("@"), F.col("lang")))
        .when(F.col("kind") == "Typed", F.concat(quoted, F.lit("^^<"), F.col("datatype"), F.lit(">")))
        .otherwise(quoted)
    )


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """line: one for each triple."""
    return triples.select(F.concat_ws(" ", _subject(), F.concat(F.lit("<"), F.col("predicate"), F.lit(">")), _object(), F.lit(".")).alias("line"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.text(path)


def coerced(text: Column, datatype: Column, lang: Column, node: Column) -> list[Column]:
    """The object columns of a literal or node; a number or boolean that doesn't parse stays a string."""
    name = F.when(datatype.startswith(XSD), F.substr(datatype, F.lit(len(XSD) + 1)))
    whole = F.when(name.isin("integer", "int", "long") & text.rlike(r"^[+-]?\d{1,18}$"), text.cast("long"))
    real = F.when(name.isin("double", "float", "decimal") & text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.cast("double"))
    truth = F.when(name == "boolean", F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False))
    known = name.isin("integer", "int", "long", "double", "float", "decimal", "boolean", "string")
    kind = (
        F.when(node.isNotNull(), "Node")
        .when(lang.isNotNull(), "LangString")
        .when(whole.isNotNull(), "Integer")
        .when(real.isNotNull(), "Float")
        .when(truth.isNotNull(), "Boolean")
        .when(name == "dateTime", "DateTime")
        .when(datatype.isNotNull() & ~F.coalesce(known, F.lit(False)), "Typed")
        .otherwise("String")
    )
    plain = kind.isin("String", "LangString", "DateTime", "Typed")
    return [kind.alias("kind"), node.alias("node"), F.when(plain, text).alias("str"), whole.alias("int"), real.alias("dbl"), truth.alias("bool"), F.when(kind == "Typed", datatype).alias("datatype"), lang.alias("lang")]


def parse_ntriples(lines: DataFrame, column: str = "line") -> DataFrame:
    """Triples of lines; blank lines and comments are skipped, other lines that don't parse fail the job."""
    line = F.col(column)
    rows = lines.where(F.trim(line).startswith("#") == F.lit(False)).where(F.trim(line) != "")
    part = lambda i: F.nullif(F.regexp_extract(line, _LINE, i), F.lit(""))
    bad = F.raise_error(F.concat(F.lit("not N-Triples: "), line))
    subject = F.coalesce(part(1), part(2), F.when(~line.rlike(_LINE), bad.cast("string")))
    text = F.when(part(4).isNull() & part(5).isNull(), _unescape(F.regexp_extract(line, _LINE, 6)))
    node = F.coalesce(part(4), part(5))
    return rows.select(subject.alias("subject"), F.when(part(1).isNull(), "blank").otherwise("named").alias("subject_kind"), part(3).alias("predicate"), *coerced(text, part(8), part(7), node))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path), "value")


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """subject, block: a Turtle statement for each subject, predicates and objects in order.

    A subject's facts meet in one group; what it has is bounded by the node's degree.
    """
    predicate = F.when(F.col("predicate").isin(RDF_TYPE, "rdf:type"), "a").otherwise(F.concat(F.lit("<"), F.col("predicate"), F.lit(">")))
    by = triples.groupBy(_subject().alias("subject"), predicate.alias("p")).agg(F.array_join(F.sort_array(F.collect_list(_object())), " , ").alias("objects"))
    rows = by.groupBy("subject").agg(F.sort_array(F.collect_list(F.concat_ws(" ", "p", "objects"))).alias("parts"))
    return rows.select("subject", F.concat(F.col("subject"), F.lit(" "), F.array_join("parts", " ;\n    "), F.lit(" .\n")).alias("block"))


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>]*>)|(?P<str>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*\w)|(?P<num>[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)(?![\w:]))|(?P<name>[\w-]*:[\w./%-]*[\w/%-]|[\w-]*:)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])""",
    re.X,
)


def turtle_rows(text: str) -> Iterator[tuple]:
    """(subject, subject_kind, predicate, node, text, datatype, lang) of each triple; property lists with content are refused."""
    tokens = []
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not Turtle at {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
    prefixes: dict[str, str] = {}
    base, i, blanks = "", 0, 0

    def iri(token: tuple[str, str]) -> str:
        kind, value = token
        if kind == "iri":
            inner = value[1:-1]
            return base + inner if base and ":" not in inner else inner
        if kind == "name":
            prefix, _, local = value.partition(":")
            if prefix not in prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return prefixes[prefix] + local
        raise ValueError(f"an IRI was expected, not {value!r}")

    def plain(value: str) -> str:
        inner = value[3:-3] if value.startswith('"""') else value[1:-1]
        return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), inner, flags=re.S)

    while i < len(tokens):
        kind, value = tokens[i]
        if (kind == "lang" and value in ("@prefix", "@base")) or (kind == "word" and value.lower() in ("prefix", "base")):
            if value.lower().endswith("prefix"):
                prefixes[tokens[i + 1][1][:-1]] = iri(tokens[i + 2])
                i += 3
            else:
                base = iri(tokens[i + 1])
                i += 2
            if i < len(tokens) and tokens[i] == ("mark", "."):
                i += 1
            continue
        if kind == "blank":
            subject = (value[2:], "blank")
            i += 1
        elif value == "[" and tokens[i + 1][1] == "]":
            blanks += 1
            subject = (f"anon{blanks}", "blank")
            i += 2
        else:
            subject = (iri(tokens[i]), "named")
            i += 1
        while True:
            verb = tokens[i]
            predicate = RDF_TYPE if verb == ("word", "a") else iri(verb)
            i += 1
            while True:
                kind, value = tokens[i]
                node = text_ = datatype = lang = None
                i += 1
                if kind == "str":
                    text_ = plain(value)
                    if i < len(tokens) and tokens[i][0] == "lang":
                        lang = tokens[i][1][1:]
                        i += 1
                    elif i < len(tokens) and tokens[i][0] == "type":
                        datatype = iri(tokens[i + 1])
                        i += 2
                elif kind == "num":
                    text_, datatype = value, XSD + ("integer" if re.fullmatch(r"[+-]?\d+", value) else "double")
                elif kind == "word" and value in ("true", "false"):
                    text_, datatype = value, XSD + "boolean"
                elif kind == "blank":
                    node = value[2:]
                elif value == "[":
                    if tokens[i][1] != "]":
                        raise ValueError("blank node property lists aren't supported")
                    blanks += 1
                    node = f"anon{blanks}"
                    i += 1
                else:
                    node = iri((kind, value))
                yield (*subject, predicate, node, text_, datatype, lang)
                if i < len(tokens) and tokens[i] == ("mark", ","):
                    i += 1
                    continue
                break
            while i < len(tokens) and tokens[i] == ("mark", ";"):
                i += 1
            if i < len(tokens) and tokens[i] == ("mark", "."):
                i += 1
                break
            if i >= len(tokens):
                raise ValueError("a statement doesn't end")


def parse_turtle(documents: DataFrame, column: str = "content", type_as: str = "rdf:type") -> DataFrame:
    """Triples of whole Turtle documents; the type predicate is named as the model names it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["subject", "subject_kind", "predicate", "node_", "text", "datatype_", "lang_"]
        for frame in frames:
            rows = [r for text in frame[column] if text for r in turtle_rows(text)]
            yield pd.DataFrame(rows, columns=names).astype(object)

    rows = documents.select(column).mapInPandas(run, "subject string, subject_kind string, predicate string, node_ string, text string, datatype_ string, lang_ string")
    predicate = F.when(F.col("predicate") == RDF_TYPE, type_as).otherwise(F.col("predicate"))
    return rows.select("subject", "subject_kind", predicate.alias("predicate"), *coerced(F.col("text"), F.col("datatype_"), F.col("lang_"), F.col("node_")))


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    return parse_turtle(spark.read.text(path, wholetext=True), "value")


__all__ = ["ntriples_lines", "parse_ntriples", "parse_turtle", "read_ntriples", "read_turtle", "turtle_blocks", "write_ntriples"]
