"""A training corpus from documents: the stages, in order, and their composition.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of ``documents``; between two stages the rows are
written and read again. Extra columns of ``docs`` are not read. n_chars
follows the text wherever a stage changes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm import language, minhash, packing, pii, repeats
from careflow.session import checkpoint_dir

#: words of the shortest passage that goes when it is repeated
PASSAGE_WORDS = 51

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text shows a language; ``lang`` becomes the one identified.

    Learns as the operator's query does, from labelled rows of other folds
    than 1. Texts without a letter, null ones included, go. Documents that are
    kept keep their text. Where no row is labelled in those folds, nothing is
    learned: texts with a letter stay, with the ``lang`` they have.
    """
    rows = docs.select(*COLUMNS)
    model = language.learn(rows.where(language.fold() != 1), "text", "lang", "doc_id")
    if not model[0]:
        return rows.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(rows, model, carry=["text", "source", "n_chars"])
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(
        "doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that of the smallest doc_id.

    Of rows that repeat a doc_id one stays. Rows without a doc_id, which no
    class can name, all stay.
    """
    rows = docs.select(*COLUMNS)
    kept = minhash.near_duplicates(rows).where("kept").select("doc_id").distinct()
    named = rows.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct("text", "lang", "source", "n_chars")).alias("r")).select("doc_id", "r.*")
    return named.unionByName(rows.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the bytes of 400-byte strings that occur elsewhere, and passages of over 50 words
    that do, which may have fewer bytes; all documents stay.

    Words are what white space parts. A character cut apart goes whole. A null text stays null.
    """
    rows = docs.select(*COLUMNS)
    found = repeats.without_repeats(rows, keep_text=True, carry=["lang", "source"], words=PASSAGE_WORDS)
    return found.select("doc_id", F.col("kept").alias("text"), "lang", "source",
                        F.length("kept").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; all documents stay."""
    found = pii.replace(docs.select(*COLUMNS), carry=["lang", "source"])
    return found.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: one row for each piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit),
]

#: No stage but the filters is in SQL's reach; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, writing each one's rows before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shared = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = f"{shared}/{n}-{name}.parquet"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
