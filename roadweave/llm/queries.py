"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadweave.llm.embedding_dedup import op4_embedding_dedup
from roadweave.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from roadweave.llm.html_extract import op10_html_extract
from roadweave.llm.jaccard_join import op8_jaccard_join
from roadweave.llm.lexical_search import OP13_SQL, op13_lexical_search
from roadweave.llm.merkle_manifest import OP12_SQL, op12_merkle_manifest
from roadweave.llm.mixing import op3_mix
from roadweave.llm.quality import op7_quality
from roadweave.llm.sentencepiece_scan import op5_sentencepiece
from roadweave.llm.suffix_decontaminate import OP11_SQL, op11_decontaminate
from roadweave.llm.token_files import op6_token_files
from roadweave.llm.toxicity import op2_toxicity
from roadweave.llm.warc import op9_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_mix": op3_mix,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_files": op6_token_files,
    "op7_quality": op7_quality,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_warc": op9_warc,
    "op10_html_extract": op10_html_extract,
    "op11_decontaminate": op11_decontaminate,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op11_decontaminate": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
