"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from sentiscope.llm import chat, licenses, line_quality, mixing
from sentiscope.llm.alignment import op11_alignment
from sentiscope.llm.decontam import op9_decontamination
from sentiscope.llm.fm_quality import op7_quality
from sentiscope.llm.langid import op5_language_id
from sentiscope.llm.ngram_join import op8_ngram_join
from sentiscope.llm.packing import op12_packing
from sentiscope.llm.substring_dedup import op3_substring_dedup
from sentiscope.llm.token_counts import op1_token_counts
from sentiscope.llm.whitening import op13_whitening

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_mixing": mixing.op2_mixing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_rotation": chat.op4_chat_rotation,
    "op5_language_id": op5_language_id,
    "op6_line_quality": line_quality.op6_line_quality,
    "op7_quality": op7_quality,
    "op8_ngram_join": op8_ngram_join,
    "op9_decontamination": op9_decontamination,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_alignment": op11_alignment,
    "op12_packing": op12_packing,
    "op13_whitening": op13_whitening,
}

#: The others cannot be put in SQL (a tokenizer file, fitted models, edit distances, graph
#: components, eigenvectors) or would take SQL too long on whole tables (op3); tests hold them against
#: brute force on small fixtures.
SQL: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op4_chat_rotation": chat.SQL,
    "op6_line_quality": line_quality.SQL,
    "op10_license_scan": licenses.SQL,
}
