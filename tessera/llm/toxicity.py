"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a logistic model over
words and word beginnings; the document's score is the noisy-or of its sentences,
1 - prod(1 - p). Only document labels are given; their likelihood trains the sentence model,
which then also names the offending sentences.

Training uses a bounded sample of labelled rows: the `max_labels` smallest hashes of ids, and of these, in that order, as many texts as have
`max_bytes` together. So the sample follows from the ids alone. Scoring reads every text whole. A missed toxic document is taken to cost
`miss_cost` flagged clean ones, which raises the odds of every sentence by that factor after the fit (by less
of it where there are few toxic rows: by its power n / (n + 50)). Cases: a null or empty text scores the bias-free minimum 0;
rows with a null label or id do not train; an empty or one-sided label table gives score 0 to
all; an empty table of documents gives no rows; equal texts score alike; further columns are carried along, unless a new column has their
name. Sentences end at ``.``, ``!``, ``?`` or a line feed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import first_bytes, labelled_sample, map_arrow
from ._words import NO_LETTER, U64, Words, chunks, distinct_by_row, find, find_words, lowered, mix, prefix_hash

#: Lengths in bytes of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
SENTENCE_END = [ord(c) for c in ".!?\n"]


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def _features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index of word, hash) of each kind of feature."""
    out = [(np.arange(len(words.hash)), words.hash)]
    length = words.end - words.start
    for k in BEGINNINGS:
        at = np.flatnonzero(length > k)
        if len(at):
            out.append((at, mix(prefix_hash(words, k)[at] ^ U64(k))))
    return out


def _sentences(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(sentence of each word, first word of each sentence), numbered through the chunk."""
    ends = np.flatnonzero(np.isin(data, SENTENCE_END))
    key = np.searchsorted(ends, words.start)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (words.row[1:] != words.row[:-1])
    return np.cumsum(new) - 1, np.flatnonzero(new)


def _fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], min_docs: int, steps: int, miss_cost: float) -> ToxicityModel | None:
    """rows: (labels, bytes, offsets) of chunks. Picks features that speak for the label, then fits the noisy-or likelihood."""
    label = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0)
    positive, negative = label.sum(), (1 - label).sum()
    if not positive or not negative:
        return None
    parsed, seen = [], []
    for y, data, offsets in rows:
        words = find_words(lowered(data), offsets, NO_LETTER)
        features = _features(words)
        row, value = distinct_by_row(np.concatenate([words.row[i] for i, _ in features]), np.concatenate([h for _, h in features]))
        hashes, inverse = np.unique(value, return_inverse=True)
        seen.append((hashes, np.bincount(inverse, y[row], len(hashes)), np.bincount(inverse, 1 - y[row], len(hashes))))
        parsed.append((data, words, features))
    hashes, inverse = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
    pos, neg = (np.bincount(inverse, np.concatenate([s[k] for s in seen]), len(hashes)) for k in (1, 2))
    a, b = (pos + 0.5) / (positive + 1), (neg + 0.5) / (negative + 1)
    pooled = (pos + neg + 1) / (positive + negative + 2)
    gain = 2 * (pos * np.log(a / pooled) + neg * np.log(b / pooled))
    keep = (pos >= min_docs) & (np.log(a / b) >= 2.0) & (gain >= 10)
    features = hashes[keep]
    # Sparse sentences: only those with a feature are kept apart, the others count.
    cells, doc_of, plain, base = [], [], [], 0
    n_sentences = 0
    for (y, _, _), (data, words, found) in zip(rows, parsed, strict=True):
        sentence, first = _sentences(data, words)
        pairs_s, pairs_f = [], []
        for i, h in found:
            at = find(features, h)
            hit = at >= 0
            pairs_s.append(sentence[i[hit]])
            pairs_f.append(at[hit])
        s, f = np.concatenate(pairs_s), np.concatenate(pairs_f)
        s, f = distinct_by_row(s, f)
        used, place = np.unique(s, return_inverse=True)
        row_of = words.row[first] if len(first) else np.zeros(0, np.int64)
        cells.append((place + n_sentences, f))
        doc_of.append(row_of[used] + base)
        plain.append(np.bincount(row_of, minlength=len(y)) - np.bincount(row_of[used], minlength=len(y)))
        n_sentences += len(used)
        base += len(y)
    cell_s, cell_f = (np.concatenate([c[k] for c in cells]) for k in (0, 1))
    doc, plain_n = np.concatenate(doc_of), np.concatenate(plain)
    theta = np.append(np.full(len(features), 2.0), -7.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(cell_s, theta[cell_f], n_sentences)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        total = np.bincount(doc, -np.logaddexp(0, z), len(label)) - plain_n * np.logaddexp(0, theta[-1])
        none = np.clip(np.exp(total), 1e-12, 1 - 1e-9)
        slope = np.where(label == 1, none / (1 - none), -1.0) / len(label)  # of the loss by the log of no toxic sentence
        dz = -p * slope[doc]
        grad = np.append(np.bincount(cell_f, dz[cell_s], len(features)) + 1e-5 * theta[:-1], dz.sum() - (p0 * plain_n * slope).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel(features, theta[:-1], float(theta[-1] + math.log(miss_cost) * positive / (positive + 50)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_labels: int = 8000, max_bytes: int = 64 << 20, miss_cost: float = 4.0, min_docs: int = 3, steps: int = 300, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> ToxicityModel | None:
    """Trains on at most `max_labels` labelled rows and `max_bytes` of text; None if they do not hold both labels."""
    one = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("label"))
    picked = labelled_sample(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), one, max_labels)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _fit([(np.asarray(b.column("label").to_numpy(zero_copy_only=False), float), data, offsets) for b, data, offsets in first_bytes(batches, "text", max_bytes)], min_docs, steps, miss_cost)
        if model is not None:
            yield pa.RecordBatch.from_arrays([pa.array([model.features.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["features", "weights", "bias"])

    got = map_arrow(picked, fit, "features binary, weights binary, bias double").collect()
    return ToxicityModel(np.frombuffer(bytes(got[0][0]), U64), np.frombuffer(bytes(got[0][1])), got[0][2]) if got else None


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text", locate: bool = False) -> DataFrame:
    """`docs` without its text, with `toxicity` (0 to 1), and if asked `offending`: the sentences of at least 0.5, in code points."""
    keep = [f for f in docs.schema.fields if f.name not in (text, "toxicity", "offending")]
    names = [f.name for f in keep]
    plain = docs.select(*[F.col(n) for n in names], F.coalesce(F.col(text), F.lit("")).alias("__tessera_text"))
    features, weights, bias = (model.features, model.weights, model.bias) if model else (np.zeros(0, U64), np.zeros(0), -50.0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "__tessera_text"):
            words = find_words(lowered(data), offsets, NO_LETTER)
            sentence, first = _sentences(data, words)
            z = np.full(len(first), bias)
            pairs = []
            for i, h in _features(words):
                at = find(features, h)
                hit = at >= 0
                pairs.append((sentence[i[hit]], at[hit]))
            s, f = distinct_by_row(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
            z += np.bincount(s, weights[f] if len(f) else None, len(first)) if len(f) else 0
            row = words.row[first] if len(first) else np.zeros(0, np.int64)
            none = np.bincount(row, np.logaddexp(0, z), batch.num_rows)
            columns = [batch.column(n) for n in names] + [pa.array(-np.expm1(-none))]
            if locate:
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                last = np.append(first[1:], len(words.start)) - 1
                found = [[] for _ in range(batch.num_rows)]
                for k in np.flatnonzero(z >= 0):
                    r = row[k]
                    found[r].append({"start": int(chars[words.start[first[k]]] - chars[offsets[r]]), "end": int(chars[words.end[last[k]]] - chars[offsets[r]]), "p": float(1 / (1 + np.exp(-z[k])))})
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))))
            yield pa.RecordBatch.from_arrays(columns, [*names, "toxicity", *(["offending"] if locate else [])])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "toxicity double", *(["offending array<struct<start:bigint,end:bigint,p:double>>"] if locate else [])])
    return map_arrow(plain, score, schema)
