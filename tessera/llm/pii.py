"""Personal data by weak supervision, with built-in expressions only.

1. Patterns propose spans. Four labelers (pattern, gazetteer, context, shape) vote on each:
   1 private, 0 not, -1 no opinion.
2. Votes are counted by pattern of votes over the whole table (at most kinds x 3**4 counts).
   Expectation-maximisation on these counts estimates the prior and each labeler's reliability.
3. The posteriors train a logistic span classifier on ten binary features, again from counts.
4. Base spans (valid email, ip, card, phone) always stay; spans of the other kinds are added
   where the classifier says at least 0.5 and no base span overlaps them.

Offsets count code points, ends are exclusive. Cases: a null or empty text has no spans; equal
texts get equal spans; an empty table trains nothing and adds nothing; long texts are scanned
whole (patterns are possessive or bounded, so that a long run of digits or letters costs linear
time); columns of the input are kept, except those with the name of a new one, which it replaces.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "local_phone")

#: The base patterns in a form without needless backtracking. A run can only start
#: where the previous match ended or where no character of the run precedes.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+"
_LOCAL = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z.-])"

#: Gazetteers of words that stand before private and before harmless values.
PRIVATE_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access key", "auth", "credential", "phone", "tel", "call", "mobile", "fax", "mail", "contact", "card", "visa", "iban", "ip", "host", "server")
HARMLESS_WORDS = ("version", "licen", "isbn", "doi", "issn", "commit", "checksum", "sha1", "sha256", "md5", "section", "chapter", "page", "release", "build")

LABELERS = ("pattern", "gazetteer", "context", "shape")
FEATURES = ("secret", "local_phone", "base", "quoted", "assigned", "private_word", "harmless_word", "hex", "mixed", "long")


_HIT = "struct<start:bigint,end:bigint,hit:string,before:string,after:string>"


def _found(hits: Column, pieces: Column) -> Column:
    """Structs (start, end, hit, before, after) from the matches of a pattern and the pieces between them, in order."""
    none = F.array().cast(f"array<{_HIT}>")
    nexts = F.transform(F.slice(pieces, 2, F.size(hits)), lambda p: F.substring(p, 1, 2))
    around = F.zip_with(F.slice(pieces, 1, F.size(hits)), nexts, lambda p, q: F.struct(F.length(p).alias("gap"), F.substring(p, -24, 24).alias("before"), q.alias("after")))
    joined = F.zip_with(hits, around, lambda h, p: F.struct(h.alias("hit"), p.alias("p")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]["gap"]
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["p"]["before"].alias("before"), x["p"]["after"].alias("after"))
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], F.array(one.cast(_HIT))).alias("out"))

    spans = F.aggregate(joined, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, spans).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """The Luhn sum of the digits is divisible by 10."""
    reversed_ = F.filter(F.split(F.reverse(_digits(hit)), ""), lambda d: d != "")

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, n * 2 - 9).otherwise(n * 2)

    return F.aggregate(F.transform(reversed_, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, spans: Column) -> Column:
    n = lambda x: F.length(_digits(x["hit"]))
    if kind == "ip":
        return F.filter(spans, lambda x: F.forall(F.split(x["hit"], r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$")))
    if kind == "card":
        return F.filter(spans, lambda x: n(x).between(13, 19) & _luhn(x["hit"]))
    if kind == "phone":
        return F.filter(spans, lambda x: n(x).between(9, 15))
    return spans


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("(?i)(?<![a-z])(?:" + "|".join(words) + ")")


def _judged(kind: str, spans: Column) -> Column:
    """Votes of the labelers (base 3 digits, vote + 1) and a bit mask of features for each span."""

    def judge(x: Column) -> Column:
        hit, before, after = x["hit"], x["before"], x["after"]
        quoted = before.rlike("[\"'`]$") & after.rlike("^[\"'`]")
        assigned = before.rlike("[=:]\\s*[\"'`]?$")
        private, harmless = _any_word(before, PRIVATE_WORDS), _any_word(before, HARMLESS_WORDS)
        is_hex = hit.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")
        share = F.length(_digits(hit)) / F.length(hit)
        mixed = share.between(0.15, 0.9) & hit.rlike("[A-Za-z]")
        if kind == "secret":
            pattern = F.when(is_hex, 1).when(mixed, -1).otherwise(0)
            shape = F.when(mixed, 1).otherwise(0)
        else:
            pattern, shape = F.lit(1 if kind in BASE_KINDS else -1), F.lit(-1)
        gazetteer = F.when(harmless, 0).when(private, 1).otherwise(-1)
        context = F.when(assigned | quoted, 1).when(before.rlike(r"[A-Za-z0-9/_.]$"), 0).otherwise(-1)
        votes = sum(((v + 1) * 3**i for i, v in enumerate((pattern, gazetteer, context, shape))), F.lit(0))
        flags = (F.lit(kind == "secret"), F.lit(kind == "local_phone"), F.lit(kind in BASE_KINDS), quoted, assigned, private, harmless, is_hex, mixed, F.length(hit) >= 32)
        bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), votes.cast("int").alias("votes"), bits.cast("int").alias("bits"))

    return F.transform(spans, judge)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with columns base_spans and more_spans: arrays of (kind, start, end, votes, bits), sorted by kind as listed, then start."""
    keep = [c for c in docs.columns if c.lower() not in ("base_spans", "more_spans", "spans")]
    df = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = F.col("text")
    digits, at, plus = t.rlike("[0-9]"), F.instr(t, "@") > 0, F.instr(t, "+") > 0
    cheap = {"email": (_EMAIL, at), "ip": (_IP, digits & t.rlike(r"[0-9]\.[0-9]")), "card": (_CARD, digits & t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), "phone": (_PHONE, plus), "secret": (_SECRET, digits & t.rlike(r"[A-Za-z0-9_-]{20}")), "local_phone": (_LOCAL, digits & t.rlike("[0-9]{3}[.-][0-9]{4}"))}
    none = F.array().cast("array<string>")
    df = df.withColumns({f"__m_{k}": F.when(test, F.regexp_extract_all(t, F.lit(regex), F.lit(0))).otherwise(none) for k, (regex, test) in cheap.items()})
    df = df.withColumns({f"__p_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(t, regex, -1)).otherwise(none) for k, (regex, _) in cheap.items()})
    df = df.withColumns({f"__{k}": _found(F.col(f"__m_{k}"), F.col(f"__p_{k}")) for k in cheap})
    base = F.concat(*[_judged(k, _valid(k, F.col(f"__{k}"))) for k in BASE_KINDS])
    more = F.concat(*[_judged(k, F.col(f"__{k}")) for k in ADDED_KINDS])
    df = df.withColumn("base_spans", base).withColumn("more_spans", more)
    free = F.filter("more_spans", lambda m: ~F.exists("base_spans", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    # A generator of one row: filters on spans stay above it, so that no filter searches a text again.
    df = df.select("row", F.inline(F.array(F.struct("base_spans", free.alias("more_spans")))))
    return df.select(*[F.col("row")[c].alias(c) for c in keep], "base_spans", "more_spans")


@dataclass(frozen=True)
class SpanModel:
    """What the counts taught: labeler reliabilities P(vote | private), and the weights of the classifier."""

    prior: float = 0.5
    reliability: dict[str, tuple[tuple[float, ...], tuple[float, ...]]] = field(default_factory=dict)
    bias: float = -1.0
    weights: tuple[float, ...] = (0.0,) * len(FEATURES)

    def score(self, bits: Column) -> Column:
        z = F.lit(self.bias)
        for i, w in enumerate(self.weights):
            z = z + F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, w).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def _votes(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(len(LABELERS))]


def _expectation_maximisation(counts: dict[int, int], rounds: int = 60) -> tuple[float, list[list[list[float]]], dict[int, float]]:
    """Two-class reliabilities from counts of vote patterns; starts from the share of positive opinions.

    A vote of 0 in the code is no opinion and says nothing about the class.
    """
    post = {}
    for code in counts:
        said = [v for v in _votes(code) if v]
        post[code] = (1 + sum(v == 2 for v in said)) / (2 + len(said))
    prior, table = 0.5, []
    for _ in range(rounds):
        total = sum(counts.values())
        prior = (1 + sum(n * post[c] for c, n in counts.items())) / (2 + total)
        table = []
        for j in range(len(LABELERS)):
            seen = [[0.0, 3.0, 1.0], [0.0, 1.0, 3.0]]  # a labeler is taken to be right more often than not
            for c, n in counts.items():
                v = _votes(c)[j]
                if v:
                    seen[1][v] += n * post[c]
                    seen[0][v] += n * (1 - post[c])
            table.append([[x / sum(row) for x in row] for row in seen])
        for c in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(_votes(c)) if v)
            post[c] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return prior, table, post


def _fit_logistic(cells: dict[int, tuple[float, float]], rounds: int = 400, ridge: float = 1e-3) -> tuple[float, tuple[float, ...]]:
    """Weighted logistic regression on feature cells {bits: (weight, weight of label 1)} by gradient steps."""
    k = len(FEATURES)
    total = sum(n for n, _ in cells.values())
    w = [0.0] * (k + 1)
    rows = [([1.0, *[float(bits >> i & 1) for i in range(k)]], n / total, y / total) for bits, (n, y) in cells.items()]
    for _ in range(rounds):
        grad = [ridge * x for x in w]
        for x, n, y in rows:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, v in enumerate(x):
                grad[i] += (n * p - y) * v
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w[0], tuple(w[1:])


def fit_spans(found: DataFrame) -> SpanModel:
    """Estimates reliabilities and trains the classifier from one grouped count over all candidate spans."""
    spans = found.select(F.inline(F.concat("base_spans", "more_spans"))).groupBy("votes", "bits").count()
    counted = [(r["votes"], r["bits"], r["count"]) for r in spans.collect()]  # at most 3**4 x 2**10 counts, few in practice
    if not counted:
        return SpanModel()
    by_votes: dict[int, int] = {}
    for votes, _, n in counted:
        by_votes[votes] = by_votes.get(votes, 0) + n
    prior, table, post = _expectation_maximisation(by_votes)
    cells: dict[int, tuple[float, float]] = {}
    for votes, bits, n in counted:
        a, b = cells.get(bits, (0.0, 0.0))
        cells[bits] = (a + n, b + n * post[votes])
    bias, weights = _fit_logistic(cells)
    return SpanModel(prior, {name: (tuple(table[j][0]), tuple(table[j][1])) for j, name in enumerate(LABELERS)}, bias, weights)


def find_pii(docs: DataFrame, text: str = "text", model: SpanModel | None = None, threshold: float = 0.5) -> DataFrame:
    """`docs` with base_spans and spans (base ones and those that the classifier adds), arrays of (kind, start, end)."""
    found = candidates(docs, text)  # a row travels as one struct there, so that no name of a step meets one of the input
    model = fit_spans(candidates(docs.select(text), text)) if model is None else model
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    added = F.filter("more_spans", lambda s: model.score(s["bits"]) >= threshold)
    return found.withColumns({"spans": F.concat(plain(F.col("base_spans")), plain(added)), "base_spans": plain(F.col("base_spans"))}).drop("more_spans")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans, the first one's kind stands for all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))).otherwise(text)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
