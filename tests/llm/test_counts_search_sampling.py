"""Brute-force comparisons and awkward inputs for collocations, exact top-k search and importance resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bit_slices, collocations, fingerprints, importance, mixing, ngram_join, toxicity
from tessera.llm._tables import first_bytes

SCHEMA = "doc_id long, text string, lang string, phrase string, score double, rank string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    words = ["ab", "Cd", "éf", "gh", "i", "jk", "l1", "x\x00y", "Éa"]
    rows = []
    for i in range(60):
        line = [r.choice(words) for _ in range(r.randint(0, 40))]
        if i % 3 == 0:
            line[3:3] = ["New", "York", "city", "hall"]
        rows.append((i, "".join(w + r.choice([" ", " ", " ", "\t", ". ", "\n", " ,", "\r"]) for w in line), ["en", "de", None][i % 3 if i < 40 else 0], "clash", 1.0, "clash"))
    rows += [(100, None, "en", None, None, None), (101, "", None, None, None, None), (102, "only", "xx", None, None, None), rows[0], rows[0], (103, "long word " * 20_000, "en", None, None, None), (-7, "New York city hall", "en", None, None, None), (None, "no id here", "en", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def loops(rows, longest, least, covered, most):
    f, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r["lang"] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(r["text"])):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rank = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= covered * a and inside(p, q) for q, b in frequent.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rank)[:most])]
    return sorted(out)


@pytest.mark.parametrize(("longest", "least", "covered", "most", "shards"), [(5, 5, 100, 2000, 4), (3, 2, 100, 7, 1), (4, 4, 60, 50, 3)])
def test_collocations_equal_loops(docs, nothing, longest, least, covered, most, shards):
    got = collocations.collocations(docs, longest, least, covered, most, shards)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = loops(docs.collect(), longest, least, covered, most)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5
    assert collocations.collocations(nothing, longest, least, covered, most, shards).count() == 0


def test_shared_cells_change_no_result(docs, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 8)
    assert sorted(map(tuple, collocations.collocations(docs, 5, 5).collect())) == loops(docs.collect(), 5, 5, 100, 2000)


def test_cells_shared_with_other_lengths_cut_no_cycle(spark, monkeypatch):
    # Few cells and many frequent words: longer phrases meet words in their cells before any phrase of their length is scanned.
    monkeypatch.setattr(collocations, "BITS", 6)
    r = random.Random(8)
    lines = [[f"v{r.randrange(300)}" for _ in range(r.randint(2, 7))] for _ in range(40)]
    rows = [(i, " ".join(w for _ in range(8) for w in r.choice(lines)), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    want = loops(docs.collect(), 5, 5, 100, 2000)
    assert sorted(map(tuple, collocations.collocations(docs, 5, 5).collect())) == want and len(want) > 100


def vectors():
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(0, 0.3, 7)], "clash") for i in range(-60, 300)]
    rows += [(500, None, ""), (501, [], ""), (502, [1.0, None], ""), (503, [float("nan")] * 7, ""), (504, [float("inf")] * 7, ""), (None, [9.0] * 7, ""), (600, [2.0, -3.0], ""), (601, [0.0] * 9 + [50.0], "")]
    rows += [(i, [0.5] * 7, "") for i in range(700, 760)] + [rows[70]] * 3 + [(50, [1.0] * 7, "")]
    return rows


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_top_k_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(bit_slices, "BROADCAST_BYTES", limit)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").repartition(3)
    got = bit_slices.top_k(df, df.where("vec_id % 50 = 0"), k=5, block_rows=100, query_rows=3)
    some = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in some:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in some if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert bit_slices.top_k(empty, empty).count() == 0 and bit_slices.top_k(df, empty).count() == 0 and bit_slices.top_k(empty, df).count() == 0


def test_all_rows_are_returned_if_there_are_few(spark):
    df = spark.createDataFrame([(0, [0.5, 0.25]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in bit_slices.top_k(df, df.where("vec_id = 0"), k=5).orderBy("rank").collect()] == [(0, 1, 1, 49152), (0, 2, 2, -32768)]


def test_crc_of_spans_of_any_length():
    r = random.Random(1)
    data = r.randbytes(5_000)
    spans = [(a, r.choice([0, 1, 2, 3, 7, 64, 900])) for a in (r.randrange(4_000) for _ in range(300))]
    got = importance.crc_of_spans(np.frombuffer(data, np.uint8), np.array([a for a, _ in spans]), np.array([n for _, n in spans]))
    assert got.tolist() == [zlib.crc32(data[a : a + n]) for a, n in spans]


@pytest.mark.parametrize(("runs", "percent", "least_words"), [(2, 25, 20), (1, 100, 0), (3, 50, 3)])
def test_resampling_equals_loops(spark, docs, nothing, runs, percent, least_words):
    target = spark.createDataFrame([("new york, NEW york",), (None,), ("hall of éf",), ("",)], "text string")

    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    bucket = lambda x: zlib.crc32(x.encode()) % 500
    rows = [(r["doc_id"], *features(r["text"])) for r in docs.collect()]
    s, t = Counter(bucket(x) for _, _, f in rows for x in f), Counter(bucket(x) for r in target.collect() for x in features(r["text"])[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 500) / ((s[b] + 1) * (all_t + 500)))) for b in range(500)}
    scored = []
    for i, n, f in rows:
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in scored if x[1] >= least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    some = order[: percent * len(order) // 100]
    want = Counter((*x, i + 1) for i, x in enumerate(some)) + Counter((*x, None) for x in order[len(some) :]) + Counter((*x, None) for x in scored if x[1] < least_words)
    got = importance.resample(docs, target, runs=runs, buckets=500, percent=percent, least_words=least_words)
    assert Counter(map(tuple, got.collect())) == want and some
    assert importance.resample(nothing, target).count() == 0
    assert importance.resample(docs, nothing).count() == len(rows)
    assert set(importance.resample(docs, nothing).columns) == {"doc_id", "n_words", "n_features", "weight", "score", "rank"}


def test_samples_do_not_depend_on_partitions(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["good", "plain", "words", "here", "x", "y"]) for _ in range(30)) + (" awful nasty." if i % 4 == 0 else "."), int(i % 4 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scores, posteriors = [], []
    for n in (1, 5):
        dealt = df.orderBy(F.rand(n)).repartition(n)
        model = toxicity.fit_toxicity(dealt.select("doc_id", "text"), dealt.select("doc_id", "toxic"), max_labels=100)
        scores.append(sorted(map(tuple, toxicity.score_toxicity(dealt.select("doc_id", "text"), model).collect())))
        domains = mixing.fit_domains(dealt.select("doc_id", "text"), dealt.select("doc_id", F.when(F.col("toxic") == 1, "a").otherwise("b").alias("domain")), max_labels=100, max_bytes=5_000)
        posteriors.append((domains.words.tolist(), domains.measures.tolist()))
    assert scores[0] == scores[1] and posteriors[0] == posteriors[1]
    assert sum(p >= 0.5 for _, p in scores[0]) == 100


def test_first_bytes_stop_at_the_budget():
    batches = [pa.RecordBatch.from_pydict({"text": ["aaaa", None, "bbb", "cc"]}), pa.RecordBatch.from_pydict({"text": ["d" * 50, "e"]})]
    seen = lambda most: [x for b, _, _ in first_bytes(iter(batches), "text", most) for x in b.column("text").to_pylist()]
    assert seen(100) == ["aaaa", None, "bbb", "cc", "d" * 50, "e"]
    assert seen(9) == ["aaaa", None, "bbb", "cc"] and seen(8) == ["aaaa", None, "bbb"] and seen(20) == ["aaaa", None, "bbb", "cc"] and seen(1) == ["aaaa"]


def test_targets_out_of_reach_show_in_the_shares(spark):
    df = spark.createDataFrame([(i, f"word{i} " * 10, [0.9, 0.1]) for i in range(20)], "doc_id long, text string, posterior array<double>").withColumn("n_tokens", F.lit(10).cast("long"))
    rated, shares = mixing.fit_rates(df, ("a", "b"), {"a": 0.1, "b": 0.9}, max_steps=20)
    assert shares[1] < 0.5 and rated.columns == [*df.columns, "rate"] and rated.where("rate < 0 OR rate IS NULL").count() == 0


def test_large_cells_fall_into_squares(spark, monkeypatch):
    """Documents of one template that do not link, and some that do: the same classes whatever the size of a square."""
    r = random.Random(3)
    template = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join([*template, *(f"w{r.randrange(10**9)}" for _ in range(45))])) for i in range(150)]
    rows += [(1000 + i, rows[i][1] + " more words") for i in range(0, 150, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for cell in (7, 1_000):
        monkeypatch.setattr(ngram_join, "CELL", cell)
        got.append(sorted(map(tuple, ngram_join.similarity_classes(df, k=5, percent=75, frequent=8).select("doc_id", "component_id").collect())))
    assert got[0] == got[1] and dict(got[0]) == {i: i % 1000 for i, _ in rows}


@pytest.mark.parametrize("blocks", [1, 7, 400])
def test_next_texts_in_any_number_of_ranges(spark, blocks):
    r = random.Random(blocks)
    rows = [(r.randrange(-300, 900), f"text {i % 50}") for i in range(300)] + [(None, "no id"), (None, "another"), (5, None)]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), blocks=blocks).collect()
    line = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = Counter((i, t, line[(k + 1) % len(line)][1]) for k, (i, t) in enumerate(line))
    assert Counter(map(tuple, got)) == want
