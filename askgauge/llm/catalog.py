"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat import OP1_SQL, op1_chat_format
from .contamination import OP7_SQL, op7_contamination
from .jaccard_join import OP6_SQL, op6_jaccard_join
from .k2_treap import OP11_SQL, op11_ranked_search
from .lang_kernel import op8_language
from .minhash_join import OP13_SQL, op13_minhash_dedup
from .mixing import OP5_SQL, op5_source_mix
from .packed_ids import op4_token_ids
from .simhash import op2_fingerprints
from .site_lines import OP3_SQL, op3_site_lines
from .spelling import op12_spelling_variants
from .suffix_dedup import op9_suffix_dedup
from .toxic_kernel import op10_toxicity

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_fingerprints": op2_fingerprints,
    "op3_site_lines": op3_site_lines,
    "op4_token_ids": op4_token_ids,
    "op5_source_mix": op5_source_mix,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_contamination": op7_contamination,
    "op8_language": op8_language,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_minhash_dedup": op13_minhash_dedup,
}

ORACLE = {
    "op1_chat_format": OP1_SQL,
    "op3_site_lines": OP3_SQL,
    "op5_source_mix": OP5_SQL,
    "op6_jaccard_join": OP6_SQL,
    "op7_contamination": OP7_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_minhash_dedup": OP13_SQL,
}
