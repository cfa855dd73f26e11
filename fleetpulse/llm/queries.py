"""The registered queries of this package and the SQL that checks them, where SQL can express one."""

from __future__ import annotations

from . import chat, mixing, postings, trie
from .bpe import op1_bpe_encoding
from .chat import op9_chat_formatting
from .fingerprint import op8_document_fingerprints
from .grammar import op12_structure_repair
from .html import op2_html_extraction
from .mixing import op4_mixing
from .postings import op13_decontamination
from .quality import op6_quality_rules
from .secrets import op7_secret_scans
from .simhash import op5_simhash_near_dedup
from .suffixes import op10_suffix_array_dedup
from .toxicity import op3_toxicity
from .trie import op11_prefix_trie

QUERIES = {
    "op1_bpe_encoding": op1_bpe_encoding,
    "op2_html_extraction": op2_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scans": op7_secret_scans,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_decontamination": op13_decontamination,
}

ORACLES: dict[str, str] = {
    "op4_mixing": mixing.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op13_decontamination": postings.ORACLE,
}
