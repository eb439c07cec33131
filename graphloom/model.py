"""The triple model: flat columns, content ids, display forms and the order of values.

A triples DataFrame has subject, subject_kind ('named', 'hash', 'blank'), predicate, and the object
as a tagged union in flat columns, so that Parquet statistics and column pruning reach its parts:
kind says which of node, str, int, dbl, bool (with datatype, lang) holds the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = ("node", "str", "int", "dbl", "bool", "datatype", "lang")
COLUMNS = ("subject", "subject_kind", "predicate", "kind", *PAYLOAD)
SCHEMA = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("subject", "subject_kind", "predicate", "kind", "node", "str")]
    + [T.StructField("int", T.LongType()), T.StructField("dbl", T.DoubleType()), T.StructField("bool", T.BooleanType())]
    + [T.StructField(x, T.StringType()) for x in ("datatype", "lang")]
)
#: The rank of each kind in the order of values; null is last.
KIND_RANK = {"Node": 0, "String": 1, "Integer": 2, "Float": 3, "Boolean": 4, "DateTime": 5, "Typed": 6, "LangString": 7, "Bytes": 8, "Json": 9, "Null": 255}


def value(kind: str, **payload: Column) -> list[Column]:
    """The object columns of a value: value('Node', node=...), value('Integer', int=...)."""
    types = {f.name: f.dataType for f in SCHEMA.fields}
    return [F.lit(kind).alias("kind"), *[payload.get(x, F.lit(None)).cast(types[x]).alias(x) for x in PAYLOAD]]


def node_display(kind: Column, name: Column) -> Column:
    """<name> of named nodes, _:hash:<16 digits>, _:b<id>."""
    return F.when(kind == "hash", F.concat(F.lit("_:hash:"), F.substring(name, 1, 16))).when(kind == "blank", F.concat(F.lit("_:b"), name)).otherwise(F.concat(F.lit("<"), name, F.lit(">")))


def value_text(prefix: str = "") -> Column:
    """The bare text of an object, whatever its kind; null of the kind Null."""
    c = lambda x: F.col(prefix + x)
    return F.coalesce(c("node"), c("str"), c("int").cast("string"), c("dbl").cast("string"), c("bool").cast("string"))


def value_display(prefix: str = "") -> Column:
    """<iri>, "string", "string"@lang, "string"^^datatype, or the number or boolean itself."""
    kind, text = F.col(prefix + "kind"), F.col(prefix + "str")
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    return (
        F.when(kind == "Node", F.concat(F.lit("<"), F.col(prefix + "node"), F.lit(">")))
        .when(kind == "String", quoted)
        .when(kind == "LangString", F.concat(quoted, F.lit("@"), F.col(prefix + "lang")))
        .when(kind == "Typed", F.concat(quoted, F.lit("^^<"), F.col(prefix + "datatype"), F.lit(">")))
        .otherwise(value_text(prefix))
    )


def triple_id() -> Column:
    """SHA-256 of the content (subject, predicate, object); metadata is no part of it."""
    parts = [F.coalesce(F.col(x).cast("string"), F.lit("\x00")) for x in COLUMNS]
    return F.sha2(F.concat_ws("\x01", *parts), 256)


def with_id(triples: DataFrame) -> DataFrame:
    return triples.withColumn("triple_id", triple_id())


def value_order(prefix: str = "") -> list[Column]:
    """The sort columns of the total order of values."""
    rank = F.lit(255)
    for kind, r in KIND_RANK.items():
        rank = F.when(F.col(prefix + "kind") == kind, r).otherwise(rank)
    return [rank, *[F.col(prefix + x) for x in ("node", "int", "dbl", "bool", "datatype", "lang", "str")]]


def namespace(name: Column) -> Column:
    return F.substring_index(name, ":", 1)


def local_name(name: Column) -> Column:
    return F.substring_index(name, ":", -1)
