"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from graphloom.llm.chat import OP6_SQL, op6_chat_format
from graphloom.llm.decontaminate import op7_decontaminate
from graphloom.llm.divergence import OP13_SQL, op13_source_divergence
from graphloom.llm.line_dedup import OP12_SQL, op12_line_dedup
from graphloom.llm.mixing import OP3_SQL, op3_mix_sources
from graphloom.llm.ngram_join import op1_ngram_join
from graphloom.llm.pii import op4_pii
from graphloom.llm.quality import op10_quality_rules
from graphloom.llm.spelling import OP11_SQL, op11_spelling_variants
from graphloom.llm.token_counts import op2_token_counts
from graphloom.llm.token_files import op9_token_files
from graphloom.llm.toxicity import op5_toxicity
from graphloom.llm.warc import op8_warc

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_token_counts": op2_token_counts,
    "op3_mix_sources": op3_mix_sources,
    "op4_pii": op4_pii,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_token_files": op9_token_files,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_line_dedup": op12_line_dedup,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE = {"op3_mix_sources": OP3_SQL, "op6_chat_format": OP6_SQL, "op11_spelling_variants": OP11_SQL, "op12_line_dedup": OP12_SQL, "op13_source_divergence": OP13_SQL}
