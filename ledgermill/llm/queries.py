"""The queries of this subpackage and, where SQL can express one, its SQL."""

from .decontamination import op3_decontamination
from .fingerprints import op1_fingerprints
from .language import op2_language
from .lexical_search import SQL as LEXICAL_SQL
from .lexical_search import op11_lexical_search
from .line_dedup import op6_line_dedup
from .packing import op8_packing
from .passages import SQL as PASSAGES_SQL
from .passages import op13_substring_dedup
from .quality import op9_quality
from .sharding import op7_sharding
from .simhash import op4_simhash
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op10_token_counts
from .vector_codes import SQL as VECTOR_SQL
from .vector_codes import op12_vector_codes

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_language": op2_language,
    "op3_decontamination": op3_decontamination,
    "op4_simhash": op4_simhash,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_token_counts": op10_token_counts,
    "op11_lexical_search": op11_lexical_search,
    "op12_vector_codes": op12_vector_codes,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL = {
    "op11_lexical_search": LEXICAL_SQL,
    "op12_vector_codes": VECTOR_SQL,
    "op13_substring_dedup": PASSAGES_SQL,
}
