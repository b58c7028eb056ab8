"""A corpus pipeline over documents: quality, exact and near duplicates, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import Scratch, shared_path, stored, table
from roadweave.llm.exact_dedup import DigestIndex
from roadweave.llm.jaccard_join import similar_groups
from roadweave.llm.mixing import Mixture
from roadweave.llm.quality import fit_quality, score_quality
from roadweave.llm.sentencepiece_scan import summary

LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose score is below LEAST_QUALITY; the classifier is fitted on the labelled ones among docs."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, "__rw_score").where(F.col("__rw_score") >= LEAST_QUALITY).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest doc_id of each text."""
    index = DigestIndex(spark, shared_path(spark, "digest-index"))
    return index.deduplicate(docs).where("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of similar ones. A null id is kept: it names no group."""
    groups = similar_groups(docs)
    gone = stored(groups.where("component_id <> doc_id").select("doc_id"), "dropped")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources; a document taken twice has two rows, one taken in part holds the words of its blocks."""
    return Mixture(docs).documents()


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token counts and checksums of each document of the mixture."""
    return summary(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokens),
]

#: The first, third and later stages cannot be put into SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark), None
    for name, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), name.split()[0].lower())
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
