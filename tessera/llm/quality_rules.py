"""Quality rules as a ledger of bits.

Every rule is evaluated once for each document. The ledger keeps the measurements and one
integer whose bit b says that rule b failed. A policy is a named, versioned set of rules
(a mask): it rejects a document when ``ledger & mask`` is not 0. What each rule costs is read
off the same integers by bitwise aggregation, so that a new policy needs no second pass
over the texts. Only built-in expressions are used.

Cases: a null or blank text has 0 words and fails ``too_few_words``; rows with the same text
get the same ledger; an empty table gives an empty ledger; columns beyond the id and the text
are carried along unless they have the name of a measurement, which then replaces them.
A text is measured whole, whatever its length. Windows count as equal by their words: hashes only bring them together (in a text
of n words 64 less log2(n) bits; a repeat could be missed only where other words with the same bits stand between).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of a word list, and symbols that prose has few of. Fixed values.
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules; ratios are per word or per line."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_word: float = 0.25
    max_dup_line_share: float = 0.7
    min_mean_word: float = 2.0
    max_mean_word: float = 25.0
    max_capital_share: float = 0.6


RULES = ("too_few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "capitals")


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


BASE_POLICY = Policy("base", 1, RULES[:2])
DEFAULT_POLICY = Policy("prose", 2, RULES)


def _measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and the measurements. A row travels as one struct, so that no name of a step meets one of the input."""
    own = F.struct(*keep) if keep else F.struct(F.lit(0).alias("nothing"))
    df = docs.select(own.alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.withColumn("w", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    # One long per 3-word window: the upper bits are its hash, the lower `b` bits its place, so that
    # sorting longs brings equal windows together. b is the least that holds the word count. Where the upper bits agree the words decide.
    b = F.length(F.bin(F.size("w").cast("long")))
    df = df.withColumn("low", F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    window = F.transform(F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("h", i + 1), F.get("h", i + 2)).bitwiseAND(F.bitwise_not("low")).bitwiseOR(i.cast("long")))
    df = df.withColumn("s", F.sort_array(window))
    words_at = lambda x: F.slice("w", x.bitwiseAND(F.col("low")).cast("int") + 1, 3)
    same = lambda x, y: (x.bitwiseXOR(y) >= 0) & (x.bitwiseXOR(y) <= F.col("low")) & (words_at(x) == words_at(y))  # noqa: E731  equal upper bits leave only place bits
    pair = F.zip_with(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))), F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), lambda x, y: F.when(same(x, y), F.array(x, y)))
    df = df.withColumn("p", F.sort_array(F.array_distinct(F.transform(F.flatten(F.filter(pair, lambda p: p.isNotNull())), lambda x: x.bitwiseAND(F.col("low"))))))
    steps = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x, y: F.least(y - x, F.lit(3).cast("long")))
    covered = F.when(F.size("p") > 0, F.aggregate(steps, F.lit(3).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANK, "")) > 0)
    df = df.withColumn("l", lines).withColumn("c", F.translate("text", BLANK, ""))
    measures = {
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length("c").cast("long"),
        "n_symbols": (F.length("c") - F.length(F.translate("c", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("l").cast("long"),
        "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
        "n_repeat_words": covered,
        "n_capitals": (F.length("c") - F.length(F.regexp_replace("c", r"\p{Lu}", ""))).cast("long"),
    }
    # A generator of one row: filters on measurements stay above it, so that no filter measures a text again.
    measured = df.select("row", F.inline(F.array(F.struct(*[m.alias(name) for name, m in measures.items()]))))
    return measured.select(*[F.col("row")[c].alias(c) for c in keep], *measures)


def rule_columns(limits: Limits = Limits()) -> dict[str, Column]:
    """A boolean column for each rule, true where it fails; in the order of RULES."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return {
        "too_few_words": words < limits.min_words,
        "repeated_windows": F.col("n_repeat_words") * 100 > words * limits.max_repeat_percent,
        "symbols": F.col("n_symbols") > words * limits.max_symbols_per_word,
        "duplicate_lines": F.col("n_dup_lines") > F.col("n_lines") * limits.max_dup_line_share,
        "short_words": chars < words * limits.min_mean_word,
        "long_words": chars > words * limits.max_mean_word,
        "capitals": F.col("n_capitals") > chars * limits.max_capital_share,
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def quality_ledger(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """`docs` without its text, with the measurements and `ledger` (bit b set: RULES[b] failed)."""
    keep = [c for c in docs.columns if c != text and c.lower() not in MEASURES and c.lower() != "ledger"]
    df = _measured(docs, text, keep)
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(rule_columns(limits).values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return df.withColumn("ledger", total)


def apply_policy(ledger: DataFrame, policy: Policy, as_column: str = "kept") -> DataFrame:
    """The verdict of a policy on each row of a ledger."""
    return ledger.withColumn(as_column, F.col("ledger").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that it fails, that it alone fails, and that the policy keeps without it."""
    hit = F.col("ledger").bitwiseAND(F.lit(policy.mask))
    counts = ledger.groupBy(hit.alias("hit")).count()  # at most 2 ** len(RULES) rows
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules])
    return counts.select("hit", "count", F.inline(rules)).groupBy("rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("hit") == F.col("bit"), F.col("count")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("hit").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
    )


def policy_report(ledger: DataFrame, policies: Mapping[str, Policy]) -> DataFrame:
    """Documents kept by each of several policies, from one pass over the ledger."""
    counts = ledger.groupBy("ledger").count()
    named = F.array(*[F.struct(F.lit(k).alias("policy"), F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask")) for k, p in policies.items()])
    kept = F.when(F.col("ledger").bitwiseAND(F.col("mask")) == 0, F.col("count")).otherwise(0)
    return counts.select("ledger", "count", F.inline(named)).groupBy("policy", "version").agg(F.sum(kept).alias("n_kept"), F.sum("count").alias("n_docs"))
