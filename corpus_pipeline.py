"""The corpus pipeline: five stages from raw documents to token ids.

Each stage reads what its predecessor wrote. All but the last return the
columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, secrets, sentencepiece, simhash
from tidemark.llm.shared import table, written

#: A document of whose letters a smaller share has its main language is rejected as a mixture.
LEAST_LANGUAGE_SHARE = 0.5

#: Models and state differ from SQL's reach in most stages; see the brute-force tests.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have a language; names it where the label is missing.

    Null and empty texts and texts without a letter go, and so do texts of
    which no language has half the letters; of languages with equal shares the
    first by name is a text's. Texts are read whole. Rows without doc_id and
    repeated rows stay; other columns, of any name, are kept. An empty table
    stays empty.
    """
    told, found = langid.judged(docs, langid.train(docs))
    good = told.filter((F.col(f"{found}.lang_pred") != langid.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_LANGUAGE_SHARE))
    return good.withColumn("lang", F.coalesce("lang", F.col(f"{found}.lang_pred"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of every class: the smallest doc_id, a missing one last, one of repeated rows.

    Null and blank texts are one class. Texts are read whole; other columns, of
    any name, are kept. An empty table stays empty.
    """
    return simhash.first_of_classes(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none.

    Texts are read whole; rows without doc_id and repeated rows are judged by
    their text; other columns, of any name, are kept. Either table may be empty.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. All rows stay.

    Null texts stay null, empty ones empty; texts are read whole; rows without
    doc_id and repeated rows are treated by their text; other columns, of any
    name, are kept. An empty table stays empty.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids and ids of every row; every text is decoded again, and one that differs is an error.

    A null text has null ids and n_ids 0, an empty one no ids. Rows without
    doc_id, repeated rows, very long texts and further columns are nothing
    special. An empty table gives an empty result.
    """
    coded = sentencepiece.coded(docs, sentencepiece.load())
    broken = F.raise_error(F.concat(F.lit("decoding differs for doc_id "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    ids = F.when(F.col("exact"), F.col("ids")).otherwise(broken.cast("array<int>"))
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_ids"), ids.alias("ids"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", benchmark),
    ("secrets", secret_scan),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
