"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op7_bpe_round_trip
from .fuzzy import op4_document_fingerprints
from .graphs import op11_nearest_neighbours
from .impacts import OP13_SQL, op13_lexical_search
from .langid import op6_language_id
from .media import op10_media_columns
from .minhash import op1_minhash_near_dedup
from .mixing import op3_source_mixing
from .paragraphs import op8_substring_dedup
from .rollup import OP2_SQL, op2_token_rollup
from .spelling import OP12_SQL, op12_spelling_variants
from .tokenfiles import op9_token_files
from .urls import op5_url_filter

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_token_rollup": op2_token_rollup,
    "op3_source_mixing": op3_source_mixing,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_files": op9_token_files,
    "op10_media_columns": op10_media_columns,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {"op2_token_rollup": OP2_SQL, "op12_spelling_variants": OP12_SQL, "op13_lexical_search": OP13_SQL}
