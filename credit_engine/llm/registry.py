"""Queries of this subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op11_token_alignment
from .chat import OP1_SQL, op1_chat_formatting
from .divergence import OP12_SQL, op12_source_divergence
from .lines import op13_line_dedup
from .lm import op6_lm_scores
from .media import op10_media_columns
from .mixing import op7_mixing
from .pieces import op5_sentencepiece
from .quality import op8_quality_rules
from .simhash import op3_simhash_near_dedup
from .substrings import op9_substring_dedup
from .tokens import op4_token_files
from .urls import OP2_SQL, op2_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_url_filters,
        op3_simhash_near_dedup,
        op4_token_files,
        op5_sentencepiece,
        op6_lm_scores,
        op7_mixing,
        op8_quality_rules,
        op9_substring_dedup,
        op10_media_columns,
        op11_token_alignment,
        op12_source_divergence,
        op13_line_dedup,
    )
}

ORACLES: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op2_url_filters": OP2_SQL, "op12_source_divergence": OP12_SQL}
