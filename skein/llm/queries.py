"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

import corpus_pipeline
from skein.llm.ann import op4_nearest_neighbours
from skein.llm.bpe import op11_byte_bpe
from skein.llm.decontaminate import op5_decontamination
from skein.llm.langid import op7_language_id
from skein.llm.pieces import op2_sentencepiece
from skein.llm.pii import op8_pii
from skein.llm.prefix_trie import op13_prefix_trie
from skein.llm.quality import op3_quality_classifier
from skein.llm.repeats import op1_repeats
from skein.llm.secrets import op10_secrets
from skein.llm.simhash import op9_simhash
from skein.llm.token_blocks import op6_token_blocks
from skein.llm.whitening import op12_whitening

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_decontamination": op5_decontamination,
    "op6_token_blocks": op6_token_blocks,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_secrets": op10_secrets,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
