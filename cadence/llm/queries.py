"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .caps import op10_embedding_caps
from .divergence import op13_source_divergence
from .forest import op11_hash_forest
from .licenses import op4_licenses
from .mixing import op9_mixing
from .neardup import op1_near_duplicates
from .oracles import ORACLES  # noqa: F401
from .packing import op7_packing
from .passages import op5_passages
from .quality import op6_quality
from .suffix import op8_suffix_arrays
from .token_files import op3_token_files
from .toxicity import op2_toxicity
from .variants import op12_spelling_variants

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_toxicity": op2_toxicity,
    "op3_token_files": op3_token_files,
    "op4_licenses": op4_licenses,
    "op5_passages": op5_passages,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_suffix_arrays": op8_suffix_arrays,
    "op9_mixing": op9_mixing,
    "op10_embedding_caps": op10_embedding_caps,
    "op11_hash_forest": op11_hash_forest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}
