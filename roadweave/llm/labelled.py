"""The labelled documents that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import held_out


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, text, lang, label of all training documents, whole: those with a label whose crc32(doc_id) mod 5 is not 0.

    Rows with a null label or id are left out; of an id's labels the least counts. The join always
    shuffles the texts, so that its disk grows as the input does, also where labels of small inputs could be broadcast.
    """
    known = labels.where(~held_out() & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__rw_id")).agg(F.min(label).cast("int").alias("__rw_label"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), lang.alias("lang"))
    return texts.join(known.hint("merge"), F.col("doc_id") == F.col("__rw_id")).select("doc_id", "text", "lang", F.col("__rw_label").alias("label"))
