"""Registered queries of the corpus operators: each runs its operator over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import byte_bpe, language_id, licenses, toxicity
from palisade.llm.centroids import cluster_vectors
from palisade.llm.collocations import collocations
from palisade.llm.dart_minhash import near_duplicates
from palisade.llm.host_rules import host_verdicts
from palisade.llm.neighbours import linked_vectors
from palisade.llm.packing import packed_documents
from palisade.llm.pivot_search import top_k
from palisade.llm.records import read_records, write_records
from palisade.llm.repeats import remove_repeats
from palisade.session import shared_folder, stored

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of each document; a third of them is held out from all fitting."""
    docs = table(spark, sf_dir, "documents")
    network = language_id.fit(docs)
    return language_id.predict(docs.select("doc_id", "text"), network).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score"
    )


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of each document, its own or inherited.  Its path is its source, then its id in directories of a thousand."""
    docs = table(spark, sf_dir, "documents")
    shelf = F.floor(F.col("doc_id") / 1000).cast("string")
    files = licenses.scan(docs.select("doc_id", F.concat_ws("/", "source", shelf, "doc_id").alias("path"), "text"))
    files = stored(files).withColumn("is_license_file", F.col("share") >= licenses.FILE_SHARE)
    return licenses.inherit(files).drop("share")


@query
def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of token ids written to the shared folder and read back from there."""
    folder = f"{shared_folder(spark)}/records-{os.urandom(8).hex()}"
    write_records(table(spark, sf_dir, "documents"), folder, WORD_BPE, end_id=1)
    return read_records(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each document, its own verdict, and the one that counts its host's in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"))
    return host_verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes they decode to."""
    return byte_bpe.digests(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each piece of each document in the packed sequences."""
    packed = packed_documents(table(spark, sf_dir, "documents"), WORD_BPE, end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document; a third of the labels is held out from all fitting."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", language_id.held_out().alias("held_out"), "score", "predicted"
    )


@query
def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector, and whether it is the one that stays."""
    found = linked_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left and removed per document, with the digest of what is kept."""
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of each document, and whether it is the one that stays."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


@query
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of each vector after three rounds from 16 vectors, its distance and the inertia."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, scale=64, dim=64)


@query
def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors with the highest inner product with each hundredth vector."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two to four words of each language."""
    return collocations(table(spark, sf_dir, "documents"), least=30, longest=4, within=80, scale=2_000_000, first=2000)
