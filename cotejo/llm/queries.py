"""Queries of the training-data operators, by name; their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, filter_audit, lines, oracles, page_text, vector_codes
from .decontaminate import op5_decontaminate
from .filter_audit import op13_filter_audit
from .langid import op6_language_id
from .lines import op8_line_dedup
from .lm_score import op7_lm_score
from .near import op9_near_dedup
from .packing import op4_packing
from .page_text import op11_html_text
from .sharding import op1_sharding
from .substrings import op10_substring_dedup
from .suffixes import op3_suffix_dedup
from .syncmers import op2_fingerprints
from .vector_codes import op12_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_fingerprints": op2_fingerprints,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_language_id": op6_language_id,
    "op7_lm_score": op7_lm_score,
    "op8_line_dedup": op8_line_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_html_text": op11_html_text,
    "op12_vector_codes": op12_vector_codes,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate.ORACLE,
    "op8_line_dedup": lines.ORACLE,
    "op3_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op9_near_dedup": oracles.NEAR_DEDUP,
    "op10_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op11_html_text": page_text.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
