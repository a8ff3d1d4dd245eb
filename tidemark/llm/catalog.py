"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from .conversation_trie import OP11_SQL, op11_conversation_trie
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .langid import op9_langid
from .packing import op5_packing, pack_dialogues
from .pii import op3_pii
from .quality_bayes import op2_quality_bayes
from .quality_rules import OP4_SQL, op4_quality_rules
from .sentencepieces import op7_sentencepieces
from .sharding import op13_sharding
from .simhash import op6_simhash
from .spotsigs import op1_spotsigs
from .substrings import op10_suffix_array
from .tokens import op8_token_counts


def queries() -> dict:
    named = {f.__name__: f for f in (op1_spotsigs, op2_quality_bayes, op3_pii, op4_quality_rules, op5_packing, op6_simhash, op7_sentencepieces, op8_token_counts, op9_langid, op10_suffix_array, op11_conversation_trie, op12_hard_negatives, op13_sharding, pack_dialogues)}
    return named | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op4_quality_rules": OP4_SQL, "op11_conversation_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}
