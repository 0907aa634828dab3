"""The queries of this package and, where SQL can express them on whole tables, the same in DuckDB's SQL."""

from __future__ import annotations

from sievespark.llm.ann import op5_nearest
from sievespark.llm.bpe import op4_byte_bpe
from sievespark.llm.chat import op1_tool_calls
from sievespark.llm.langid import op9_language_id
from sievespark.llm.line_dedup import op3_line_dedup
from sievespark.llm.media import op8_media_columns
from sievespark.llm.mixing import op10_mixing
from sievespark.llm.oracles import ORACLE_SQL
from sievespark.llm.packing import op13_packing
from sievespark.llm.pii import op7_personal_data
from sievespark.llm.resample import op12_resampling
from sievespark.llm.simhash import op2_simhash
from sievespark.llm.toxicity import op6_toxicity
from sievespark.llm.whitening import op11_whitening

QUERIES = {
    "op1_tool_calls": op1_tool_calls,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_nearest": op5_nearest,
    "op6_toxicity": op6_toxicity,
    "op7_personal_data": op7_personal_data,
    "op8_media_columns": op8_media_columns,
    "op9_language_id": op9_language_id,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_resampling": op12_resampling,
    "op13_packing": op13_packing,
}
__all__ = ["ORACLE_SQL", "QUERIES"]
