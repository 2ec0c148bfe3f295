"""Queries of this subpackage and their SQL."""

from tidemark.llm.chat_format import OP3_SQL, op3_chat_format
from tidemark.llm.decontaminate import OP6_SQL, op6_decontaminate
from tidemark.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from tidemark.llm.license_scan import op10_license_scan
from tidemark.llm.pieces import op8_sentencepiece
from tidemark.llm.simhash import op2_simhash
from tidemark.llm.suffix_dedup import OP7_SQL, op7_suffix_dedup
from tidemark.llm.token_counts import op1_token_counts
from tidemark.llm.toxicity import op9_toxicity
from tidemark.llm.url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_chat_format": op3_chat_format,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_decontaminate": op6_decontaminate,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_license_scan": op10_license_scan,
}
ORACLE_SQL = {
    "op3_chat_format": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_decontaminate": OP6_SQL,
    "op7_suffix_dedup": OP7_SQL,
}
