"""Mixing documents to target domain weights with soft membership.

1. A softmax classifier, trained on a bounded sample of a labelled table, gives every
   document a posterior over domains from hashed words and a few measurements of its text.
2. Nonnegative rates r are fitted so that the expected tokens of each domain, sum(r * tokens * posterior),
   match the targets: least squares with a small pull of r to 1, by projected gradient steps.
   A step needs the K domain totals only. They are one aggregate over the documents, and since the rate of a
   document follows from its posterior and the K errors of each step, no rates are stored between steps.

A rate is how often a document should be taken: below 1 it is taken with that chance, above 1 more than once.

Cases: a null or empty text has no tokens and rate 1 at most by its posterior; rows with the same text get
the same posterior and rate; null labels do not train; without labels there is one domain and all rates are 1; an
empty table gives an empty result; a domain without a target has target 0; further columns are carried along.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import first_bytes, labelled_sample, map_arrow, written
from ._words import U64, chunks, distinct_by_row, find_words, lowered

WIDTH = 1 << 14  # hashed words
MARKS = b"#*$%&|<>!"


@dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    words: np.ndarray  # WIDTH x domains
    measures: np.ndarray  # measurements + 1 x domains


def _measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight of each distinct word; measurements of each row)."""
    n = len(offsets) - 1
    words = find_words(lowered(data), offsets)
    count = np.diff(words.first)
    row, value = distinct_by_row(words.row, words.hash)
    size = np.maximum(np.diff(offsets), 1)
    share = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets]) / size
    capital = (data >= ord("A")) & (data <= ord("Z"))
    measures = np.stack([share(np.isin(data, list(MARKS))), share(capital), share(data == ord("|")), np.bincount(row, minlength=n) / np.maximum(count, 1), np.log1p(count) / 10, size / np.maximum(count, 1) / 20, np.ones(n)], axis=1)
    return row, (value % U64(WIDTH)).astype(np.int64), 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row], measures


def _posteriors(model: DomainModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    row, bucket, weight, measures = _measure(data, offsets)
    z = measures @ model.measures
    for k in range(z.shape[1]):
        z[:, k] += np.bincount(row, weight * model.words[bucket, k], len(z))
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, labels: DataFrame, *, max_labels: int = 6000, max_bytes: int = 64 << 20, steps: int = 300, text: str = "text", doc_id: str = "doc_id", domain: str = "domain") -> DomainModel | None:
    """Trains on at most `max_labels` labelled documents, those with the smallest hashes of ids, and of these on the first `max_bytes` of text; None without labels."""
    one = labels.where(F.col(doc_id).isNotNull() & F.col(domain).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.min(F.col(domain).cast("string")).alias("label"))
    picked = labelled_sample(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), one, max_labels)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows, base = [], [], 0
        for batch, data, offsets in first_bytes(batches, "text", max_bytes):
            row, bucket, weight, measures = _measure(data, offsets)
            names += batch.column("label").to_pylist()
            rows.append((row + base, bucket, weight, measures))
            base += batch.num_rows
        if not base:
            return
        domains = sorted(set(names))
        row, bucket, weight = (np.concatenate([r[i] for r in rows]) for i in range(3))
        x = np.concatenate([r[3] for r in rows])
        y = np.searchsorted(domains, names)
        target = np.eye(len(domains))[y]
        theta, phi = np.zeros((WIDTH, len(domains))), np.zeros((x.shape[1], len(domains)))
        moments = [np.zeros_like(theta), np.zeros_like(theta), np.zeros_like(phi), np.zeros_like(phi)]
        for step in range(1, steps + 1):
            z = x @ phi + np.stack([np.bincount(row, weight * theta[bucket, k], base) for k in range(len(domains))], axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - target) / base
            g = np.stack([np.bincount(bucket, weight * error[row, k], WIDTH) for k in range(len(domains))], axis=1) + 1e-5 * theta
            h = x.T @ error + 1e-6 * phi
            for value, grad, m, v in ((theta, g, moments[0], moments[1]), (phi, h, moments[2], moments[3])):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(domains)]), pa.array([theta.tobytes()]), pa.array([phi.tobytes()])], ["domains", "words", "measures"])

    got = map_arrow(picked, fit, "domains string, words binary, measures binary").collect()
    if not got:
        return None
    domains = tuple(json.loads(got[0]["domains"]))
    return DomainModel(domains, np.frombuffer(bytes(got[0]["words"])).reshape(-1, len(domains)), np.frombuffer(bytes(got[0]["measures"])).reshape(-1, len(domains)))


def domain_posteriors(docs: DataFrame, model: DomainModel | None, text: str = "text") -> DataFrame:
    """`docs` without its text, with n_tokens (words) and posterior (an array in the order of model.domains)."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "n_tokens", "posterior")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "__tessera_text"):
            n = np.diff(find_words(data, offsets).first)
            p = _posteriors(model, data, offsets) if model else np.ones((batch.num_rows, 1))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], [*names, "n_tokens", "posterior"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_tokens long, posterior array<double>"])
    return map_arrow(docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("__tessera_text")), run, schema)


#: Steps that a row's rate is computed from at once; then the rates are written.
STEPS = 8


def _rate(errors: list[list[float]], pull: float, most: float = math.inf) -> Column:
    """The rate after steps with these errors, from `__rate`, each projected on [0, most]."""
    if not errors:
        return F.col("__rate")
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in e]) for e in errors])
    dot = lambda e: F.aggregate(F.zip_with(e, F.col("posterior"), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(steps, F.col("__rate"), lambda r, e: F.least(F.lit(most), F.greatest(F.lit(0.0), r - dot(e) - pull * (r - 1.0))))


def _so_far(posteriors: DataFrame, errors: list[list[float]], pull: float, most: float = math.inf) -> tuple[DataFrame, list[list[float]]]:
    """(`posteriors` with the rates of STEPS steps written, the steps since), so that no row folds all steps again and again."""
    if len(errors) < STEPS:
        return posteriors, errors
    return written(posteriors.withColumn("__rate", _rate(errors, pull, most)), "rates"), []


def fit_rates(posteriors: DataFrame, domains: tuple[str, ...], targets: Mapping[str, float], *, pull: float = 1e-4, max_steps: int = 40, tolerance: float = 2e-4) -> tuple[DataFrame, list[float]]:
    """`posteriors` with `rate`, and the shares of the token total that the rates give each domain.

    Gradient steps on half the squared miss of the shares, scaled by the inverse of the posteriors' Gram matrix over the documents whose
    rate is above 0 (K x K, from the same aggregate), projected on rates of 0 and more. Steps end when every share is within
    `tolerance` of its target; targets that no rates can meet end at `max_steps`, near the closest shares.
    """
    k = len(domains)
    goal = np.array([targets.get(d, 0.0) for d in domains])
    goal = goal / goal.sum() if goal.sum() else np.full(k, 1 / k)
    errors: list[list[float]] = []
    shares, last, damp = [], math.inf, 1.0
    posteriors = posteriors.withColumn("__rate", F.lit(1.0))
    for step in range(max_steps + 1):
        rated = posteriors.select(F.col("n_tokens").alias("t"), _rate(errors, pull).alias("r"), *[F.get("posterior", F.lit(i)).alias(f"p{i}") for i in range(k)])
        moves = F.when(F.col("r") > 0, F.col("t")).otherwise(0)
        gram = [F.sum(moves * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]
        sums = rated.agg(F.sum("t").alias("total"), *[F.sum(F.col("t") * F.col("r") * F.col(f"p{i}")).alias(f"s{i}") for i in range(k)], *gram).first()
        if not sums["total"]:
            return posteriors.withColumnRenamed("__rate", "rate"), list(goal)
        share = np.array([sums[f"s{i}"] for i in range(k)]) / sums["total"]
        shares, miss = share.tolist(), share - goal
        if np.abs(miss).max() < tolerance or step == max_steps:
            break
        norm = float(np.linalg.norm(miss))
        damp, last = (damp / 2, last) if norm > last else (min(1.0, damp * 1.5), norm)
        g = np.array([[sums[f"g{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)]) / sums["total"]
        posteriors, errors = _so_far(posteriors, [*errors, (damp * np.linalg.solve(g + 1e-6 * np.eye(k), miss)).tolist()], pull)
    return posteriors.withColumn("rate", _rate(errors, pull)).drop("__rate"), shares


def fit_keep_rates(posteriors: DataFrame, domains: tuple[str, ...], targets: Mapping[str, float], *, whole: str, max_steps: int = 60, tolerance: float = 1e-4) -> tuple[DataFrame, list[float]]:
    """`posteriors` with `rate`, a chance from 0 to 1, and the shares of the kept tokens that the rates give each domain.

    Targets are shares of the kept tokens, not of the input. Nothing is taken twice: the other domains are thinned to their
    targets, and the domain `whole` is never thinned for its own sake, so a domain with less than its target stays as it is.
    """
    k = len(domains)
    goal = np.array([targets.get(d, 0.0) for d in domains])
    goal = goal / goal.sum() if goal.sum() else np.full(k, 1 / k)
    errors: list[list[float]] = []
    own, shares = None, goal.tolist()
    posteriors = posteriors.withColumn("__rate", F.lit(1.0))
    for step in range(max_steps + 1):
        r = _rate(errors, 0.0, 1.0)
        sums = posteriors.select(F.col("n_tokens").alias("t"), r.alias("r"), "posterior").agg(F.sum("t").alias("total"), *[F.sum(F.col("t") * F.col("r") * F.get("posterior", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
        if not sums["total"]:
            return posteriors.withColumnRenamed("__rate", "rate"), shares
        mass = np.array([sums[f"s{i}"] for i in range(k)]) / sums["total"]
        kept = mass.sum()
        own = np.maximum(mass, 1e-4) if own is None else own
        shares = (mass / max(kept, 1e-12)).tolist()
        # What a domain has too much of, against the tokens that are kept now. A step moves rates that are not at a bound.
        error = np.array([min(0.0, e) if d == whole else e for d, e in zip(domains, mass - goal * kept, strict=True)])
        if np.maximum(error, 0).max() < tolerance * kept and (step == 0 or np.abs(error).max() < tolerance * kept) or step == max_steps:
            break
        posteriors, errors = _so_far(posteriors, [*errors, (error / own).tolist()], 0.0, 1.0)
    return posteriors.withColumn("rate", _rate(errors, 0.0, 1.0)).drop("__rate"), shares


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], *, whole: str | None = None, text: str = "text", doc_id: str = "doc_id", domain: str = "domain") -> tuple[DataFrame, tuple[str, ...], list[float]]:
    """(`docs` without its text, with n_tokens, posterior and rate; domains; token shares that the rates give).

    With `whole`, rates are chances to keep a document and shares are those of the kept tokens, see fit_keep_rates.
    """
    model = fit_domains(docs, labels, text=text, doc_id=doc_id, domain=domain)
    domains = model.domains if model else ("all",)
    posteriors = written(domain_posteriors(docs, model, text), "posteriors")
    if whole is not None and model:
        rated, shares = fit_keep_rates(posteriors, domains, targets, whole=whole)
    else:
        rated, shares = fit_rates(posteriors, domains, targets if model else {"all": 1.0})
    return rated, domains, shares


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the label table: toxic, good (quality 1) or poor."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain"))
