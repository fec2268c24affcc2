"""Corpus pipeline: language ID, near-duplicates, repeated passages, benchmark contamination, BPE encoding.

Each stage takes (spark, docs, folder) and returns a DataFrame; run() writes what a stage returns as Parquet in the shared
folder and rereads it as the next one's documents.  A stage takes any columns besides doc_id, text and lang, whatever they are
called, and all but the last return them as they were; of an empty table each makes an empty one.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, langid, neardup, suffixes
from millrace.llm._spark import let_go, settle, shared_dir
from millrace.llm.queries import word_bpe


def settled(stage: Callable) -> Callable:
    """stage, begun on executors that have given back what the one before made them hold."""

    @functools.wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        settle(spark)
        return stage(spark, docs, folder)

    return begin


@settled
def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is recognized, by models of the documents' own labels; lang stays as it was.

    Texts that are null or have no letter go, and so do those that no model accepts; where no row has a lang there is no model,
    and every row goes.  Repeated rows share one verdict; of equally likely languages the alphabetically first is taken.  There may
    be any number of languages, with any number of trigrams.
    """
    return langid.recognized(docs, langid.train(docs))


@settled
def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8.

    The least doc_id of a group stays; of repeated rows one stays.  Documents under five words are one shingle.  Null texts and
    texts without words are linked with nothing, and all of them stay.
    """
    return neardup.deduplicate(docs, width=5, threshold=80)


@settled
def repeats(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that occur elsewhere too; n_chars counts what is left.

    All occurrences go, the first one too, so that repeated rows of 200 bytes or more end empty.  A null text ends as an empty one.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    cut = suffixes.remove_repeats(plain, id_column=at["doc_id"], text_column=at["text"], keep=tuple(at[c] for c in docs.columns if c not in ("doc_id", "text", "n_chars")))
    kept = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return cut.select(*[kept.get(c, F.col(at[c])).alias(c) for c in docs.columns])


@settled
def contamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that share less than a twentieth of their words with windows of benchmark items.

    Null texts and texts without words share nothing and stay, as does every document where benchmark has no words.  Repeated
    rows stay or go together.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


@settled
def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, and the digests of ids and decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    A null text is an empty one, without ids.  Each row gives one row, repeated rows equal ones.
    """
    return bpe.encode_documents(docs, word_bpe()).drop("decoded")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("contamination", contamination),
    ("encode", encode),
]

#: Language models and tokenization can't be put in SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents in folder."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, folder).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
        let_go(spark)
    return docs
