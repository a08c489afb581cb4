"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from marketlake.llm import bpe, decontaminate, language, lexical, mixing, quality, secrets, sentences, simhash, suffixes, tokenbin, trie, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontaminate": decontaminate.op1,
        "op2_rans_tokens": tokenbin.op2,
        "op3_secrets": secrets.op3,
        "op4_bigru_language": language.op4,
        "op5_host_reputation": urls.op5,
        "op6_sentence_spans": sentences.op6,
        "op7_suffix_array": suffixes.op7,
        "op8_mixing": mixing.op8,
        "op9_simhash": simhash.op9,
        "op10_weak_supervision": quality.op10,
        "op11_lexical_search": lexical.op11,
        "op12_tree_bpe": bpe.op12,
        "op13_prefix_trie": trie.op13,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.ORACLE,
        "op3_secrets": secrets.ORACLE,
        "op5_host_reputation": urls.ORACLE,
        "op6_sentence_spans": sentences.ORACLE,
        "op11_lexical_search": lexical.ORACLE,
        "op13_prefix_trie": trie.ORACLE,
    }
