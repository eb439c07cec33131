"""Mixing to target weights by soft membership.

A naive Bayes classifier over hashed words, learned from the labelled table, gives every document
posteriors p_d over domains. Each document gets a rate r_d >= 0 so that the expected tokens of
each domain, M = sum_d r_d t_d p_d, match the targets T (shares of the corpus's tokens): least
squares in the norm of B^-1 with B = sum_d t_d p_d p_d', solved by projected gradient,

    r_d <- max(0, r_d - p_d . B^-1 (M - T)),

from r_d = 1. In the metric of t_d its curvature is 1 at most, so a step of 1 descends. A rate
depends on the steps' few numbers only, so no state per document is kept between
iterations: each is one aggregation of (t_d, p_d), and the driver sees sums of the size of the
number of domains.

resample() turns rates into copies: the whole part, and one more with the probability of the
rest, by a hash of doc_id. Training reads at most TRAIN_ROWS labelled documents (the first by a
hash of their id); posteriors, totals and rates cover every whole text. Tokens are words here.

Defined cases: null and empty texts have 0 tokens and the prior as posteriors; repeated rows get
equal rates (and equal numbers of copies); documents without a label, or of a domain without a target, aren't
learned from; a target whose domain was never seen can't be met, the others are
matched as well as they can, and targets_met and a warning say so; without labelled documents every rate is 1; an empty table gives an empty
result; columns of other names stay as they are.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SLOTS = 1 << 14
TRAIN_ROWS = 8000
SHARPNESS = (1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
STEPS = 60
CLOSE = 1e-7
#: Targets count as met up to this share of the corpus's tokens.
MET = 1e-4
#: Shares of the corpus's tokens, by language.
TARGETS = {"de": 0.2, "en": 0.4, "es": 0.2, "fr": 0.2}


class Posteriors:
    """log p(word slot | domain) and log priors; how sharp the mean log-likelihood is read."""

    def __init__(self, domains: list[str], logs: np.ndarray, prior: np.ndarray, sharpness: float):
        self.domains, self.logs, self.prior, self.sharpness = domains, logs, prior, sharpness

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood of a document's words by domain, and the number of words."""
        hashes, first = c.words(*c.utf8(texts))
        slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        out = np.zeros((len(first) - 1, len(self.domains)))
        for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
            if b > a:
                out[i] = self.logs[slots[a:b]].mean(0, dtype=np.float64)
        return out, np.diff(first)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        means, n = self.means(texts)
        z = self.sharpness * means * (n > 0)[:, None] + self.prior
        z = np.exp(z - z.max(1, keepdims=True)) if z.size else z
        return z / z.sum(1, keepdims=True) if z.size else z, n


def learn(docs: DataFrame, labelled: DataFrame, domain: str = "lang", targets: dict[str, float] = TARGETS, rows: int = TRAIN_ROWS) -> Posteriors | None:
    """From documents whose doc_id is in the labelled table; None if there is none."""
    c.prepare(docs.sparkSession)
    domains = sorted(targets)
    some = labelled.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.join(F.broadcast(some), "doc_id", "left_semi").where(F.col(domain).isin(domains))
    own = own.select(F.col(domain).alias("domain"), (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).cast("int").alias("held"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = c.words(*c.utf8(batch.column("text")))
            slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
            number = np.array([domains.index(d) for d in batch.column("domain").to_pylist()], np.int64)
            cell = np.repeat(number * SLOTS, np.diff(first)) + slots
            value, n = np.unique(cell, return_counts=True)
            docs_of = np.bincount(number, minlength=len(domains))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(value, -1 - np.arange(len(domains)))), pa.array(np.append(n, docs_of))], ["cell", "n"])

    training = own.where("held = 0").select("domain", "text").mapInArrow(c.tidy(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells, n = training.column("cell").to_numpy(), training.column("n").to_numpy()
    seen = np.zeros(len(domains))
    np.add.at(seen, -1 - cells[cells < 0], n[cells < 0])
    if not seen.sum():
        return None
    counts = np.zeros(len(domains) * SLOTS)
    counts[cells[cells >= 0]] = n[cells >= 0]
    counts = counts.reshape(len(domains), SLOTS) + 0.1
    logs = np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)
    model = Posteriors(domains, np.ascontiguousarray(logs), np.log((seen + 0.1) / (seen + 0.1).sum()), 1.0)

    def fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SHARPNESS))
        for batch in batches:
            number = np.array([domains.index(d) for d in batch.column("domain").to_pylist()], np.int64)
            means, n = model.means(batch.column("text"))
            for i, sharp in enumerate(SHARPNESS):
                z = sharp * means * (n > 0)[:, None] + model.prior
                top = z.max(1, keepdims=True) if z.size else z
                total[i] += (z - top - np.log(np.exp(z - top).sum(1, keepdims=True)))[np.arange(len(number)), number].sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(SHARPNESS)), pa.array(total)], ["sharp", "fit"])

    fit = own.where("held = 1").select("domain", "text").mapInArrow(c.tidy(fits), "sharp double, fit double").groupBy("sharp").agg(F.sum("fit").alias("fit")).collect()
    if fit:
        model.sharpness = max(fit, key=lambda r: (round(r["fit"], 6), -r["sharp"]))["sharp"]
    return model


def posteriors(docs: DataFrame, model: Posteriors) -> DataFrame:
    """doc_id, n_tokens, p (array by model.domains) of every document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, n = model.of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "p"])

    return docs.select("doc_id", "text").mapInArrow(c.tidy(run), f"doc_id {kind}, n_tokens long, p array<double>")


def _rate(steps: list[list[float]]):
    """The rate after the given steps, from column p."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    history = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda h: sum((F.col("p")[k] * h[k] for k in range(1, len(steps[0]))), F.col("p")[0] * h[0])
    return F.aggregate(history, rate, lambda r, h: F.greatest(F.lit(0.0), r - dot(h)))


class Steps(list):
    """The steps of projected gradient; shares: of the corpus's tokens that the rates bring to each domain; met: whether these are the targets."""

    met = True
    shares: dict[str, float] = {}


def fit_rates(table: DataFrame, domains: list[str], targets: dict[str, float]) -> Steps:
    """The steps B^-1 (M - T) of projected gradient on a table of (n_tokens, p), until the targets are met (CLOSE) or nothing moves.

    Targets that can't be met end the loop when its steps get as small as that, or after STEPS; met tells which it was.
    """
    k = len(domains)
    p = [F.col("p")[i] for i in range(k)]
    t = F.col("n_tokens")
    cells = [F.sum(t * p[i] * p[j]).alias(f"b{i}_{j}") for i in range(k) for j in range(i, k)]
    row = table.agg(F.sum(t).alias("all"), *cells).first()
    if not row["all"]:
        return Steps()
    b = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            b[i, j] = b[j, i] = row[f"b{i}_{j}"]
    whole = float(row["all"])
    share = np.array([targets[d] for d in domains])
    wanted = whole * share / share.sum()
    inverse = np.linalg.pinv(b, rcond=1e-9, hermitian=True)
    steps = Steps()
    while True:
        rated = table.select("n_tokens", "p", _rate(steps).alias("r"))
        got = rated.agg(*[F.sum(F.col("r") * t * p[i]).alias(f"m{i}") for i in range(k)]).first()
        off = np.array([got[f"m{i}"] for i in range(k)]) - wanted
        step = inverse @ off
        steps.met = bool(np.abs(off).max() <= MET * whole)
        steps.shares = {d: (o + w) / whole for d, o, w in zip(domains, off, wanted)}
        if np.abs(off).max() <= CLOSE * whole or len(steps) == STEPS or steps and np.abs(step).max() < CLOSE:
            break
        steps.append(step.tolist())
    if not steps.met:
        warnings.warn(f"the targets aren't met: shares are {steps.shares}", stacklevel=2)
    return steps


def copies(rate, doc_id):
    """Whole part of the rate, and one more with the probability of the rest by a hash of doc_id."""
    unit = F.pmod(F.xxhash64(doc_id, F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _prepared(docs: DataFrame, labelled: DataFrame, domain: str, targets: dict[str, float]) -> tuple[Posteriors | None, Steps, DataFrame | None]:
    model = learn(docs, labelled, domain, targets)
    if model is None:
        return None, Steps(), None
    table = c.materialize(posteriors(docs, model), "posteriors")
    return model, fit_rates(table, model.domains, targets), table


def rates(docs: DataFrame, labelled: DataFrame, domain: str = "lang", targets: dict[str, float] = TARGETS) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each target, rate, copies and targets_met (of the whole fit) of every document."""
    model, steps, table = _prepared(docs, labelled, domain, targets)
    if model is None:
        sized = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
        return docs.select("doc_id", sized.alias("n_tokens"), *[F.lit(None).cast("double").alias(f"p_{d}") for d in sorted(targets)], F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), F.lit(False).alias("targets_met"))
    rated = table.withColumn("rate", _rate(steps))
    return rated.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"), F.lit(steps.met).alias("targets_met"))


def resample(docs: DataFrame, labelled: DataFrame, domain: str = "lang", targets: dict[str, float] = TARGETS) -> DataFrame:
    """docs with each row as often as its copies say. Texts are scored again where they lie instead of shuffled."""
    model, steps, _ = _prepared(docs, labelled, domain, targets)
    if model is None:
        return docs
    names = docs.columns
    unit = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    source = docs.select(*[F.col(f"`{x}`").alias(f"k{i}") for i, x in enumerate(names)], F.col("text").alias("mix_text"), unit.alias("mix_unit"))
    history = np.array(steps).reshape(-1, len(model.domains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, _ = model.of(batch.column("mix_text"))
            rate = np.ones(batch.num_rows)
            for h in history:
                rate = np.maximum(0.0, rate - p @ h)
            n = np.floor(rate) + (batch.column("mix_unit").to_numpy() < rate - np.floor(rate))
            kept = batch.select([f"k{i}" for i in range(len(names))])
            spots = np.repeat(np.arange(batch.num_rows), n.astype(np.int64))
            for at in range(0, len(spots), 1024):
                yield kept.take(pa.array(spots[at : at + 1024]))

    again = source.mapInArrow(c.tidy(run), source.drop("mix_text", "mix_unit").schema)
    return again.select(*[F.col(f"k{i}").alias(x) for i, x in enumerate(names)])
