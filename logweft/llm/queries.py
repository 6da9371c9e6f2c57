"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, fingerprints, html_extraction, mixing, ngram_join, sentencepiece_codec, token_output, toxicity, url_filters, vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": html_extraction.op1_html_extraction,
        "op2_vector_search": vector_search.op2_vector_search,
        "op3_sentencepiece": sentencepiece_codec.op3_sentencepiece,
        "op4_url_filters": url_filters.op4_url_filters,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_token_output": token_output.op8_token_output,
        "op9_mixing": mixing.op9_mixing,
        "op10_chat_format": chat_format.op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": url_filters.SQL, "op9_mixing": mixing.SQL, "op10_chat_format": chat_format.SQL}
