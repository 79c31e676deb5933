"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Every stage works on all rows its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from slatewise.llm import language, mixing
from slatewise.llm.decontaminate import decontaminate
from slatewise.llm.exact_dedup import drop_copies
from slatewise.llm.near_dedup import drop_near_copies
from slatewise.llm.queries import crc_mod
from slatewise.llm.storage import new_path, save, ship, table

#: A text whose letters belong to its language by less than this share must show that it has languages at all.
MIN_SHARE = 0.4
#: It does if its n-grams are e times as likely in the languages of its words as evenly spread ones.
MIN_EVIDENCE = 1.0
MAX_COVERAGE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go, and those that have neither one language with ``MIN_SHARE`` of the letters nor, over
    all their languages, ``MIN_EVIDENCE``. Where no language was learned, all stay."""
    ship(spark)
    model = language.learn(docs.where(F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(True))).select("lang", "text"))
    if not model.languages:
        return docs
    labelled = language.label(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns}), model, text_col="own_text", with_evidence=True)
    return labelled.where((F.col("lang_pred") != language.UND) & ((F.col("score") >= MIN_SHARE) | (F.col("evidence") >= MIN_EVIDENCE))).select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the one with the largest identifier stays."""
    return drop_copies(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of documents with 0.8 of their five-word shingles in common."""
    ship(spark)
    return drop_near_copies(docs, width=5, percent=80)


def benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are benchmark by more than ``MAX_COVERAGE`` go."""
    ship(spark)
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=MAX_COVERAGE)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    rows = save(mixing.sized(docs), "sizes")
    return mixing.mix_rows(docs, rows=rows).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontaminate", benchmark_spans),
    ("mix_sources", mix_sources),
]

#: Viterbi paths, shingle components and seeded blocks are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
