"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from careflow.llm import (extraction, fingerprint, language, minhash, negatives, neighbours, packing, pii, repeats,
                          sampling, secretscan, tokencount, variants)
from careflow.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_token_counts(spark, sf_dir):
    """Token counts of all documents with the whole-token shortcut."""
    return tokencount.count_tokens(read(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query
def op1_minhash_near_dedup(spark, sf_dir):
    """Near-duplicate classes of all documents by circulant MinHash."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op8_prefix_fingerprints(spark, sf_dir):
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.edited_fingerprints(read(spark, sf_dir, "documents"))


@query
def op2_suffix_dedup(spark, sf_dir):
    """All documents without the bytes of strings of 400 bytes that occur elsewhere."""
    return repeats.without_repeats(read(spark, sf_dir, "documents"), keep_text=True).withColumnRenamed("kept", "text")


@query
def op3_language_id(spark, sf_dir):
    """Language mixtures of all documents."""
    return language.predict(read(spark, sf_dir, "documents"))


@query
def op10_projected_neighbours(spark, sf_dir):
    """The 20 nearest of every twentieth embedding."""
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


@query
def op6_pii_surrogates(spark, sf_dir):
    """All documents with surrogates for their personal data."""
    return pii.replace(read(spark, sf_dir, "documents"))


@query
def op7_sampled_pieces(spark, sf_dir):
    """Sampled segmentations of all documents, decoded again."""
    return sampling.sample_digest(read(spark, sf_dir, "documents"))


@query
def op5_wrapper_extraction(spark, sf_dir):
    """Main texts of all pages by wrapper induction."""
    return extraction.main_text(read(spark, sf_dir, "pages"))


@query
def op11_entropy_secrets(spark, sf_dir):
    """Secrets of all documents: fixed patterns and windows of high entropy."""
    return secretscan.digest(secretscan.scan(read(spark, sf_dir, "documents")))


@query
def op12_threshold_negatives(spark, sf_dir):
    """Hard negatives of every hundredth embedding."""
    return negatives.mined(read(spark, sf_dir, "embeddings"))


@query
def op13_spelling_variants(spark, sf_dir):
    """Spelling variants among the words of all documents."""
    return variants.group_variants(read(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


ORACLE["op12_threshold_negatives"] = negatives.ORACLE_SQL
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
