"""Queries of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm.bpe import op3_byte_bpe
from sieveline.llm.chroma import op7_chroma
from sieveline.llm.neardup import op4_near_duplicates
from sieveline.llm.packing import op10_best_fit_packing
from sieveline.llm.pii import op2_pii
from sieveline.llm.quality import op8_quality
from sieveline.llm.sitetree import op1_html
from sieveline.llm.tokenfile import op5_token_files
from sieveline.llm.warc import OP6_SQL, op6_warc
from sieveline.llm.winnow import op9_winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_pii": op2_pii,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_token_files": op5_token_files,
    "op6_warc": op6_warc,
    "op7_chroma": op7_chroma,
    "op8_quality": op8_quality,
    "op9_winnowing": op9_winnowing,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {"op6_warc": OP6_SQL}
