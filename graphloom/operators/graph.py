"""Triple store operators: pattern scans, paging, statistics, inserts, deletes and star pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model

MOST_ROWS = 10_000


def pattern(subject: str | None = None, predicate: str | None = None, obj: dict | None = None) -> Column:
    """Whether a triple matches; obj gives kind and payload columns, all of which must be equal."""
    cond = F.lit(True)
    if subject is not None:
        cond &= F.col("subject") == subject
    if predicate is not None:
        cond &= F.col("predicate") == predicate
    for name, x in (obj or {}).items():
        cond &= F.col(name) == x
    return cond


def find(triples: DataFrame, subject: str | None = None, predicate: str | None = None, obj: dict | None = None) -> DataFrame:
    """All eight shapes of bound and free positions; where names are computed, sources.tables.triples() takes the same positions and prunes its scans."""
    return triples.where(pattern(subject, predicate, obj))


def is_exact(subject, predicate, obj) -> bool:
    return None not in (subject, predicate, obj)


def is_wildcard(subject, predicate, obj) -> bool:
    return subject is None and predicate is None and obj is None


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 100, most: int | None = None) -> DataFrame:
    """A page of rows in a total order; the limit is the feature, and a sort with a limit keeps a task's top rows only."""
    limit = min(limit, most) if most else limit
    return rows.orderBy(*order).offset(offset).limit(limit)


def builder(triples: DataFrame, offset: int, limit: int, **bound) -> tuple[DataFrame, DataFrame]:
    """(page, summary): the summary has total_count before paging and has_more."""
    rows = find(triples, **bound)
    shown = page(rows, ["subject", "predicate", *model.value_order()], offset, limit)
    total = rows.agg(F.count(F.lit(1)).alias("total_count"))
    return shown, total.select("total_count", (F.col("total_count") - offset > limit).alias("has_more"))


def subjects_with_prefix(triples: DataFrame, prefix: str) -> DataFrame:
    return triples.where((F.col("subject_kind") == "named") & F.col("subject").startswith(prefix)).select("subject").distinct()


def in_namespace(triples: DataFrame, ns: str) -> DataFrame:
    return triples.where(F.col("subject").startswith(ns + ":"))


def scoped(ns: str, subject: Column) -> Column:
    """The subject within the namespace, prefixed unless it already is."""
    return F.when(subject.startswith(ns + ":"), subject).otherwise(F.concat(F.lit(ns + ":"), subject))


def not_hidden(rows: DataFrame, path: str, folders: list[str]) -> DataFrame:
    """Rows whose path lies in none of the folders, by whole segments, with either slash."""
    clean = F.translate(F.col(path), "\\", "/")
    hidden = F.lit(False)
    for f in folders:
        f = f.replace("\\", "/").strip("/")
        hidden |= (clean == f) | clean.startswith(f + "/")
    return rows.where(~hidden)


def stats(triples: DataFrame) -> DataFrame:
    """triples, distinct subjects, predicates and objects, and bytes of text."""
    obj = F.struct("kind", *model.PAYLOAD)
    size = F.octet_length("subject") + F.octet_length("predicate") + F.coalesce(F.octet_length(model.value_text()), F.lit(0))
    return triples.agg(
        F.count(F.lit(1)).alias("triples"),
        F.count_distinct("subject").alias("subjects"),
        F.count_distinct("predicate").alias("predicates"),
        F.count_distinct(F.to_json(obj)).alias("objects"),
        F.sum(size).cast("long").alias("bytes"),
    )


def fresh(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The distinct rows of new that aren't in existing: what a batch insert appends."""
    return model.with_id(new).dropDuplicates(["triple_id"]).join(model.with_id(existing).select("triple_id"), "triple_id", "left_anti").drop("triple_id")


def insert(existing: DataFrame, triple: DataFrame) -> DataFrame:
    """existing and one triple more; an error if it is there already."""
    if fresh(existing, triple).isEmpty():
        raise ValueError("the triple is there already")
    return existing.unionByName(triple)


def insert_batch(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(fresh(existing, new))


def delete(existing: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the triples whose triple_id is in ids."""
    return model.with_id(existing).join(ids.select("triple_id"), "triple_id", "left_anti").drop("triple_id")


def delete_by_prefix(existing: DataFrame, prefix: str) -> DataFrame:
    return existing.where(~((F.col("subject_kind") == "named") & F.col("subject").startswith(prefix)))


def get(triples: DataFrame, triple_id: str) -> DataFrame:
    return model.with_id(triples).where(F.col("triple_id") == triple_id).limit(1)


def star(triples: DataFrame, columns: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """One row per subject with a column per predicate, in one aggregation whose partial step runs before the shuffle.

    columns: name to predicate. Of several values of a predicate the greatest by text counts.
    """
    wanted = triples.where(F.col("predicate").isin(list(columns.values())))
    rows = wanted.groupBy("subject").agg(*[F.max(F.when(F.col("predicate") == p, model.value_text())).alias(n) for n, p in columns.items()])
    for n in required:
        rows = rows.where(F.col(n).isNotNull())
    return rows


def list_distinct(triples: DataFrame, column: str, limit: int) -> DataFrame:
    return triples.select(column).distinct().orderBy(column).limit(limit)


def expand(name: Column, prefixes: dict[str, str]) -> Column:
    """prefix:local to the full IRI; others stay."""
    out = name
    for p, iri in prefixes.items():
        out = F.when(name.startswith(p + ":"), F.concat(F.lit(iri), F.substr(name, F.lit(len(p) + 2)))).otherwise(out)
    return out


def compact(iri: Column, prefixes: dict[str, str]) -> Column:
    """The full IRI to prefix:local, by the longest namespace that fits; others stay."""
    out = iri
    for p, ns in sorted(prefixes.items(), key=lambda x: len(x[1])):
        out = F.when(iri.startswith(ns), F.concat(F.lit(p + ":"), F.substr(iri, F.lit(len(ns) + 1)))).otherwise(out)
    return out
