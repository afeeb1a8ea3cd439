"""Language identification with interpolated Kneser-Ney character models.

For each language the n-grams of up to four characters within words (a word starts with a mark
and ends with one) give an interpolated Kneser-Ney model. All n-grams of all languages
stand in one sorted array of hashes with a row of log-probabilities, one for each language, and
all contexts in another with their interpolation weights. A text gets the language of the lowest
cross-entropy per character; the lead over the second gives, through a logistic curve fitted on
sample documents that the counts left out, a probability that the answer is right, and texts
below `reject_below` are marked as rejected.

The models are fitted on a bounded sample of labelled rows (`max_docs` for each language, drawn by
a hash of the id); prediction reads every text whole. Cases: a null text, or one without a letter,
is `und` with score 0; rows with a null language do not train; without any labelled row every
text is `und`; equal texts get equal answers; ties go to the first language in alphabetical order;
further columns are carried along.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import in_one_task, map_arrow
from ._words import NO_LETTER, U64, chunks, find, find_words, lowered, mix

ORDER = 4
START, END = 1, 2  # code points that mark the ends of a word
STEP = U64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    grams: np.ndarray  # sorted hashes of n-grams
    log_p: np.ndarray  # n-grams x languages
    contexts: np.ndarray  # sorted hashes of contexts
    log_weight: np.ndarray  # contexts x languages
    floor: float  # log-probability of a character that no language has
    slope: float
    offset: float


def _gram_hash(gram: str) -> np.uint64:
    return _hashes(np.array([ord(c) for c in gram], np.uint64), len(gram))[-1]


def _hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols up to each place; places with fewer before them are 0."""
    value = np.zeros(len(symbols), U64)
    if len(symbols) >= n:
        part = np.zeros(len(symbols) - n + 1, U64)
        for k in range(n):
            part = part * STEP + mix(symbols[k : len(symbols) - n + 1 + k] + U64(11))
        value[n - 1 :] = mix(part + U64(n))
    return value


def _kneser_ney(words: Counter) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """Interpolated probabilities of the seen n-grams and weights of the seen contexts, by order."""
    counts: list[dict[str, float]] = [defaultdict(float) for _ in range(ORDER)]
    for word, n in words.items():
        marked = chr(START) + word + chr(END)
        for i in range(1, len(marked)):
            longest = min(ORDER, i + 1)
            counts[longest - 1][marked[i - longest + 1 : i + 1]] += n
    # Below the longest n-gram, an n-gram counts by the different characters before it, or by itself where a word starts.
    for k in range(ORDER - 1, 0, -1):
        for gram in list(counts[k]):
            counts[k - 1][gram[1:]] += 1
    prob: list[dict[str, float]] = []
    weight: list[dict[str, float]] = []
    for k in range(ORDER):
        once, twice = (sum(v == x for v in counts[k].values()) for x in (1, 2))
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        total, kinds = defaultdict(float), defaultdict(int)
        for gram, n in counts[k].items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1
        weight.append({h: discount * kinds[h] / total[h] for h in total})
        lower = prob[k - 1] if k else None
        now = {}
        for gram, n in counts[k].items():
            h = gram[:-1]
            below = lower.get(gram[1:], 0.0) if lower is not None else 1 / 4096
            now[gram] = max(0.0, n - discount) / total[h] + weight[k][h] * below
        prob.append(now)
    return prob, weight


def _probability(model: tuple[list[dict[str, float]], list[dict[str, float]]], gram: str) -> float:
    prob, weight = model
    scale = 1.0
    for k in range(len(gram), 0, -1):
        part = gram[-k:]
        if part in prob[k - 1]:
            return scale * prob[k - 1][part]
        scale *= weight[k - 1].get(part[:-1], 1.0)
    return scale / 4096


def build(samples: dict[str, Counter]) -> LanguageModel:
    """Tables for the word counts of each language."""
    languages = tuple(sorted(samples))
    models = [_kneser_ney(samples[x]) for x in languages]
    grams = sorted({g for prob, _ in models for level in prob for g in level})
    contexts = sorted({h for _, weight in models for level in weight for h in level if h})
    log_p = np.log(np.array([[_probability(m, g) for m in models] for g in grams]).reshape(-1, len(languages)))
    log_w = np.log(np.array([[m[1][len(h)].get(h, 1.0) for m in models] for h in contexts]).reshape(-1, len(languages)))
    gram_hash, context_hash = (np.array([_gram_hash(x) for x in xs], U64) for xs in (grams, contexts))
    a, b = np.argsort(gram_hash), np.argsort(context_hash)
    return LanguageModel(languages, gram_hash[a], log_p[a], context_hash[b], log_w[b], float(np.log(1 / 4096)), 50.0, 0.0)


def _word_scores(model: LanguageModel, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(log-probabilities by language, characters) of each word."""
    joined = b"\x01" + b"\x02\x01".join(raw) + b"\x02"
    symbols = np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(U64)
    word = np.cumsum(symbols == START) - 1
    depth = np.arange(len(symbols)) - np.flatnonzero(symbols == START)[word]  # place in the word
    hashes = [_hashes(symbols, k) for k in range(1, ORDER + 1)]
    score = np.zeros((len(symbols), len(model.languages)))
    open_ = depth > 0
    for k in range(ORDER, 0, -1):
        at = np.flatnonzero(open_ & (depth >= k - 1))
        where = find(model.grams, hashes[k - 1][at])
        hit = where >= 0
        score[at[hit]] += model.log_p[where[hit]]
        open_[at[hit]] = False
        missed = at[~hit]
        if k > 1:
            c = find(model.contexts, hashes[k - 2][missed - 1])
            score[missed[c >= 0]] += model.log_weight[c[c >= 0]]
        else:
            score[missed] += model.floor
    sums = np.zeros((len(raw), len(model.languages)))
    for j in range(len(model.languages)):
        sums[:, j] = np.bincount(word, score[:, j], len(raw))
    return sums, np.bincount(word, depth > 0, len(raw))


def _entropies(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy per character by language, number of words) of each row of a chunk; a word is scored once a chunk."""
    low = lowered(data)
    words = find_words(low, offsets, NO_LETTER)
    n = len(offsets) - 1
    if not len(words.hash):
        return np.zeros((n, len(model.languages))), np.zeros(n, np.int64)
    _, index, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    blob = low.tobytes()
    sums, chars = _word_scores(model, [blob[a:b] for a, b in zip(words.start[index], words.end[index], strict=True)])
    total = np.bincount(words.row, chars[inverse], n)
    out = np.stack([-np.bincount(words.row, sums[inverse, j], n) / np.maximum(total, 1) for j in range(sums.shape[1])], axis=1)
    return out, np.bincount(words.row, minlength=n)


def _lead(entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = np.argmin(entropy, axis=1)
    if entropy.shape[1] == 1:
        return best, np.ones(len(best))
    two = np.partition(entropy, 1, axis=1)[:, :2]
    return best, two[:, 1] - two[:, 0]


def fit_languages(docs: DataFrame, *, max_docs: int = 600, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel | None:
    """Fits on about `max_docs` rows of each language; every fifth of them only calibrates."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, max_docs / n) * (1 << 30))))])
    some = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples: dict[str, Counter] = {k: Counter() for k in counts}
        apart, n = [], 0
        for batch, data, offsets in chunks(batches, "text"):
            langs = batch.column("lang").to_pylist()
            low = lowered(data)
            words = find_words(low, offsets, NO_LETTER)
            blob = low.tobytes()
            held = (np.arange(len(langs)) + n) % 5 == 4
            for r, name in enumerate(langs):
                if not held[r]:
                    a, b = words.first[r], words.first[r + 1]
                    samples[name].update(blob[s:e].decode("utf-8", "replace") for s, e in zip(words.start[a:b], words.end[a:b], strict=True))
            apart.append((langs, held, data.copy(), offsets.copy()))
            n += len(langs)
        model = build({k: v for k, v in samples.items() if v} or samples)
        # The lead of left-out documents against being right: one logistic curve by Newton steps, with a weak prior.
        x, y = [], []
        for langs, held, data, offsets in apart:
            best, lead = _lead(_entropies(model, data, offsets)[0])
            right = np.array([model.languages[i] for i in best]) == np.array(langs)
            x.append(lead[held]), y.append(right[held])
        x, y = np.concatenate([*x, [0.0, 0.0, 1.0]]), np.concatenate([*y, [0, 1, 1]]).astype(float)
        w = np.array([0.0, 1.0])
        design = np.stack([np.ones_like(x), x], axis=1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            hessian = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + 1e-3 * np.eye(2)
            w = w + np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * w)
        meta = json.dumps({"languages": model.languages, "floor": model.floor, "offset": float(w[0]), "slope": float(max(w[1], 0.1))})
        yield pa.RecordBatch.from_arrays([pa.array([meta]), *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in (model.grams, model.log_p, model.contexts, model.log_weight)]], ["meta", "a", "b", "c", "d"])

    got = map_arrow(in_one_task(some, "id", "text"), fit, "meta string, a binary, b binary, c binary, d binary").collect()
    if not got:
        return None
    meta = json.loads(got[0]["meta"])
    k = len(meta["languages"])
    table = lambda raw: np.frombuffer(bytes(raw)).reshape(-1, k)
    return LanguageModel(tuple(meta["languages"]), np.frombuffer(bytes(got[0]["a"]), U64), table(got[0]["b"]), np.frombuffer(bytes(got[0]["c"]), U64), table(got[0]["d"]), meta["floor"], meta["slope"], meta["offset"])


def identify(docs: DataFrame, model: LanguageModel | None, *, reject_below: float = 0.5, text: str = "text") -> DataFrame:
    """`docs` without its text, with language, language_score (0 to 1), cross_entropy and language_rejected."""
    new = ("language", "language_score", "cross_entropy", "language_rejected")
    keep = [f for f in docs.schema.fields if f.name not in (text, *new)]
    names = [f.name for f in keep]
    plain = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("__tessera_text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in chunks(batches, "__tessera_text"):
            n = batch.num_rows
            if model is None:
                out = [pa.array(["und"] * n), pa.array([0.0] * n), pa.array([None] * n, pa.float64()), pa.array([True] * n)]
            else:
                entropy, words = _entropies(model, data, offsets)
                best, lead = _lead(entropy)
                score = 1 / (1 + np.exp(-np.clip(model.offset + model.slope * lead, -30, 30)))
                ascii_letter = np.concatenate([[0], np.cumsum(~NO_LETTER[data] & (data < 0x80))])
                lettered = (ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]) & (words > 0)
                for r in np.flatnonzero(~lettered & (words > 0)):  # rare: no ASCII letter
                    lettered[r] = any(c.isalpha() for c in batch.column("__tessera_text")[int(r)].as_py())
                score = np.where(lettered, score, 0.0)
                names_ = [model.languages[i] if ok else "und" for i, ok in zip(best, lettered, strict=True)]
                out = [pa.array(names_), pa.array(score), pa.array(np.where(lettered, entropy[np.arange(n), best], np.nan), from_pandas=True), pa.array(score < reject_below)]
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *out], [*names, *new])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "language string, language_score double, cross_entropy double, language_rejected boolean"])
    return map_arrow(plain, predict, schema)
