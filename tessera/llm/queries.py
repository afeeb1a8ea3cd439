"""The registered queries of this subpackage: thin calls of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_slices, collocations, fingerprints, html_extraction, importance, language_id, mixing, ngram_join, packing, pii, quality_rules, substring_dedup, toxicity
from ._tables import fold_of, read_table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `documents`: shingles, component and class of equal sets."""
    found = ngram_join.similarity_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, percent=75)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


#: Token shares of the mixed corpus.
TARGETS = {"good": 0.9, "poor": 0.09, "toxic": 0.01}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `documents`: tokens, domain posteriors, the rate that mixes to TARGETS, and (alike in all rows) the shares that the rates reach."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rated, domains, shares = mixing.mix(docs, mixing.quality_domains(read_table(spark, sf_dir, "labels")), TARGETS)
    return rated.select("doc_id", "source", "n_tokens", *[F.get("posterior", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(domains)], "rate", *[F.lit(float(x)).alias(f"share_{d}") for d, x in zip(domains, shares, strict=True)])


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `pages`: its main text."""
    found = html_extraction.extract_main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `documents`: words, words removed as repeats, and the digest of the rest."""
    found = substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `documents`: toxicity learned from the labels outside the held-out fifth."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(fold_of("doc_id", 5) != 0)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `documents`: fingerprints of its text and of an edited text, and their likeness."""
    docs = fingerprints.with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    docs = docs.select("doc_id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited")).withColumn("edited_sha256", F.sha2("edited", 256))
    return fingerprints.compare(docs, "text", {"edited": "near_edited", "next_text": "near_next"}, hashed=("edited",)).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of each row of `documents`, packed with every source at its share of all tokens."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), window=4096, end_id=2, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("queue").alias("source"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `documents`: counts and digest of the base spans, and all spans."""
    found = pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.BASE_KINDS], F.sha2(pii.spans_text(F.col("base_spans")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `documents`: measurements, base verdict, ledger and the verdict of the prose policy."""
    ledger = quality_rules.quality_ledger(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("ledger").bitwiseAND(F.lit(quality_rules.BASE_POLICY.mask)) != 0
    kept = quality_rules.apply_policy(ledger.withColumn("base_failed", base), quality_rules.DEFAULT_POLICY)
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", "ledger")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `documents`: language learned from the rows outside the held-out quarter."""
    docs = read_table(spark, sf_dir, "documents")
    model = language_id.fit_languages(docs.where(fold_of("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), F.col("language").alias("lang_pred"), F.col("language_score").alias("score"), "cross_entropy", F.col("language_rejected").alias("rejected"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 phrases of `documents` by the score of their worst cut."""
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), longest=5, least=100, covered=100, most=2_000)


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of `embeddings` for every row whose id is divisible by 50."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bit_slices.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `documents`: its weight towards `benchmark`, its score and, of the drawn quarter, its rank."""
    found = importance.resample(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("text"), runs=2, buckets=10_000, percent=25, least_words=20, salt="7:")
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join, "op2_mixing": op2_mixing, "op3_html_extraction": op3_html_extraction, "op4_substring_dedup": op4_substring_dedup, "op5_toxicity": op5_toxicity, "op6_fingerprints": op6_fingerprints, "op7_packing": op7_packing, "op8_pii": op8_pii, "op9_quality_rules": op9_quality_rules, "op10_language_id": op10_language_id, "op11_collocations": op11_collocations, "op12_exact_top_k": op12_exact_top_k, "op13_importance_resampling": op13_importance_resampling}
