"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op7_bpe
from .conversation_trie import OP11_SQL, op11_conversation_trie
from .decontaminate import op8_decontamination
from .embedding_dedup import OP3_SQL, op3_embedding_dedup
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .language_id import op6_language_id
from .line_dedup import OP1_SQL, op1_line_dedup
from .ngram_jaccard import OP10_SQL, op10_ngram_jaccard
from .pii import op4_pii
from .quality import op2_quality
from .secrets import op5_secrets
from .token_files import op13_token_files
from .url_filter import OP9_SQL, op9_url_filters

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_pii": op4_pii,
    "op5_secrets": op5_secrets,
    "op6_language_id": op6_language_id,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_url_filters": op9_url_filters,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_files": op13_token_files,
    "pipeline": corpus_pipeline.run,
}
#: Operators 6, 7 and 13 are held against held-out accuracy and the vocabularies' library in tests/llm.
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op3_embedding_dedup": OP3_SQL, "op9_url_filters": OP9_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_conversation_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}
