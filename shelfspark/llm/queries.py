"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from shelfspark.llm.chat_format import op4_chat_format
from shelfspark.llm.decontaminate import OP7_SQL, op7_decontamination
from shelfspark.llm.divergence import OP13_SQL, op13_source_divergence
from shelfspark.llm.language_id import op2_language_id
from shelfspark.llm.line_dedup import OP5_SQL, op5_line_dedup
from shelfspark.llm.lm_score import op8_lm_score
from shelfspark.llm.packing import op9_packing
from shelfspark.llm.pivot_search import OP6_SQL, op6_topk
from shelfspark.llm.prefix_trie import OP11_SQL, op11_conversation_trie
from shelfspark.llm.secret_scan import OP3_SQL, op3_secret_scan
from shelfspark.llm.simhash import op10_simhash
from shelfspark.llm.source_mix import op12_source_mix
from shelfspark.llm.suffix_dedup import op1_suffix_dedup

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_chat_format": op4_chat_format,
    "op5_line_dedup": op5_line_dedup,
    "op6_topk": op6_topk,
    "op7_decontamination": op7_decontamination,
    "op8_lm_score": op8_lm_score,
    "op9_packing": op9_packing,
    "op10_simhash": op10_simhash,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_source_mix": op12_source_mix,
    "op13_source_divergence": op13_source_divergence,
}

#: DuckDB SQL where it can express a query
ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": OP3_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_topk": OP6_SQL,
    "op7_decontamination": OP7_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
