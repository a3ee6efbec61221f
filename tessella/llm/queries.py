"""Registered queries of the subpackage: name -> (plan, SQL twin or None)."""

from __future__ import annotations

from tessella.llm.byte_codec import op11_byte_bpe
from tessella.llm.decontam import OP8_SQL, op8_benchmark_leaks
from tessella.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from tessella.llm.host_rules import OP3_SQL, op3_host_rules
from tessella.llm.langid import op6_language_id
from tessella.llm.lexical import OP13_SQL, op13_lexical_search
from tessella.llm.pii import op7_personal_data
from tessella.llm.piece_codec import op4_sentencepiece
from tessella.llm.quality import op1_quality
from tessella.llm.quotes import op5_quote_threads
from tessella.llm.sharding import op9_shards
from tessella.llm.simhash import op10_simhash_groups
from tessella.llm.suffix_dedup import OP2_SQL, op2_suffix_dedup

QUERIES = {
    "op1_quality": (op1_quality, None),
    "op2_suffix_dedup": (op2_suffix_dedup, OP2_SQL),
    "op3_host_rules": (op3_host_rules, OP3_SQL),
    "op4_sentencepiece": (op4_sentencepiece, None),
    "op5_quote_threads": (op5_quote_threads, None),
    "op6_language_id": (op6_language_id, None),
    "op7_personal_data": (op7_personal_data, None),
    "op8_benchmark_leaks": (op8_benchmark_leaks, OP8_SQL),
    "op9_shards": (op9_shards, None),
    "op10_simhash_groups": (op10_simhash_groups, None),
    "op11_byte_bpe": (op11_byte_bpe, None),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_lexical_search": (op13_lexical_search, OP13_SQL),
}
