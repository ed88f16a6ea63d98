"""Queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from gridsurf.llm import ann, decontaminate, language, pieces, quality, simhash, substring, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_multi_index": ann.op1_multi_index,
    "op2_pieces": pieces.op2_pieces,
    "op3_quality": quality.op3_quality,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_substring": substring.op6_substring,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_files": token_files.op8_token_files,
    "op9_language": language.op9_language,
    "op10_suffix": suffix_dedup.op10_suffix,
}

#: The others have no SQL: they train models, draw samples or hash in ways that DuckDB lacks. tests/llm holds them
#: against brute force, round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate.ORACLE,
    "op6_substring": substring.ORACLE,
    "op10_suffix": suffix_dedup.ORACLE,
}
