"""The registered queries of this subpackage and their SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, topk, trie, urls
from .alignment import op11
from .fingerprints import op13
from .jaccard import op3
from .langid import op7
from .packing import op9
from .secret_scan import op2
from .spm import op6
from .toxicity import op10

QUERIES = {
    "op1_topk_search": topk.op1,
    "op2_secret_scan": op2,
    "op3_jaccard_join": op3,
    "op4_decontamination": decontam.op4,
    "op5_url_filter": urls.op5,
    "op6_sentencepiece": op6,
    "op7_language_id": op7,
    "op8_chat_perspectives": chat.op8,
    "op9_token_packing": op9,
    "op10_toxicity": op10,
    "op11_alignment": op11,
    "op12_prefix_trie": trie.op12,
    "op13_fingerprints": op13,
}

ORACLE_SQL: dict[str, str] = {"op1_topk_search": topk.SQL, "op5_url_filter": urls.SQL, "op8_chat_perspectives": chat.SQL, "op12_prefix_trie": trie.SQL}
