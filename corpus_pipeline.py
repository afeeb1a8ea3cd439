"""A corpus pipeline: toxicity, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`. Columns of the input that have the name of an operator's
own column pass unharmed, since a row travels as one struct. A null text stays null through the filters, loses nothing to redaction, and is packed as an empty document; empty
tables pass all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, ngram_join, packing, pii, toxicity
from tessera.llm._tables import read_table, written
from tessera.llm.queries import tokenizer_path

#: Shares of the kept tokens: documents of low quality are thinned out, good ones are all kept.
MIX = {"good": 0.97, "poor": 0.03}


#: Rows and bytes of the batches of whole texts that travel to Python and back; each task holds several of them on both sides.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def _small_batches(spark: SparkSession) -> None:
    """Sets the session's batches for the stages, which run on the same executors one after another; smaller ones stay."""
    for key, most in BATCH.items():
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def _boxed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("__row"), "doc_id", "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go. The model is trained on all labelled documents that are there."""
    _small_batches(spark)
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(_boxed(docs), model).where("toxicity < 0.5").select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.75 or more, the one with the least id stays."""
    _small_batches(spark)
    return ngram_join.keep_one_of_each(docs, k=5, percent=75)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows."""
    found = pii.find_pii(_boxed(docs)).select("__row.*", F.when(F.col("text").isNotNull(), pii.redact(F.col("text"), F.col("spans"))).alias("__new"))
    columns = {"text": F.col("__new"), "n_chars": F.when(F.col("__new").isNotNull(), F.length("__new").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays with the chance of its rate (0 to 1), drawn by a hash of id and text."""
    rated, _, _ = mixing.mix(_boxed(docs), mixing.quality_domains(read_table(spark, sf_dir, "labels")), MIX, whole="good")
    drawn = F.pmod(F.xxhash64("doc_id", "__row.text"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    return rated.where(drawn).select("__row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens, every source at its share of all tokens."""
    pieces = packing.pack(docs, tokenizer_path(), window=4096, end_id=2, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("queue").alias("source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_domains),
    ("packing", pack),
]

#: SQL cannot train the models of the first and fourth stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every stage but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
