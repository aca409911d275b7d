"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage keeps rows with null and empty texts unless its rule says otherwise, and handles an empty table.
SQL can express neither the models nor the tokenizer, so ORACLE_SQL is None and the tests compare
each stage with a brute-force version.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import language_id, toxicity
from palisade.llm.dart_minhash import near_duplicates
from palisade.llm.packing import packed_documents
from palisade.llm.repeats import free_name, remove_repeats
from palisade.session import shared_folder, stored

ORACLE_SQL = None
#: Mean probability under which no language is taken as recognised.
LEAST_LANGUAGE_SCORE = 0.4


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text")


def _aside(docs: DataFrame, *results: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns named like an operator's results renamed, and what gives them back their names."""
    names = {c: free_name(docs, f"{c}_kept") for c in docs.columns if c in results}
    back = {v: k for k, v in names.items()}
    return docs.withColumnsRenamed(names), lambda kept: kept.withColumnsRenamed(back).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; null and empty texts score the bias and stay."""
    model = toxicity.fit(_texts(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    aside, back = _aside(docs, "score", "predicted")
    kept = toxicity.score(aside, model).where("predicted = 0").drop("score", "predicted")
    return back(kept)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language: those without a letter, and those of which no language has
    ``LEAST_LANGUAGE_SCORE``, go."""
    aside, back = _aside(docs, "score", "lang_pred")
    found = language_id.predict(aside, language_id.fit(docs))
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return back(kept.drop("score", "lang_pred"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest ``doc_id``; of rows that
    share it, one.  Rows with a null ``doc_id`` stay."""
    found = stored(near_duplicates(docs)).where("doc_id = class_id").select("doc_id").distinct()
    kept = docs.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds.  A text that loses nothing is unchanged;
    one that loses all its words goes; any other is its kept words, joined by one space, with its new length."""
    aside, back = _aside(docs, "n_words", "n_removed", "kept_text")
    cut = remove_repeats(aside)
    lost = F.col("n_removed") > 0
    cut = cut.where(~lost | (F.col("n_removed") < F.col("n_words"))).withColumn(
        "text", F.when(lost, F.col("kept_text")).otherwise(F.col("text"))
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(lost, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return back(cut.drop("n_words", "n_removed", "kept_text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and their places in sequences of 2048 tokens."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are in the shared folder."""
    folder = f"{shared_folder(spark)}/corpus-{os.urandom(8).hex()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
