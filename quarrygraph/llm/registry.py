"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .alignment import op11_alignment
from .decontamination import OP5_SQL, op5_decontamination
from .fingerprints import op1_fingerprints
from .jaccard_join import OP12_SQL, op12_jaccard_join
from .language import op3_language
from .licenses import op2_licenses
from .lines import OP7_SQL, op7_line_dedup
from .mixing import OP6_SQL, op6_mixing
from .near_dups import op4_near_dups
from .quality import op9_quality
from .substrings import op8_suffix_dedup
from .toxicity import op10_toxicity
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_licenses": op2_licenses,
    "op3_language": op3_language,
    "op4_near_dups": op4_near_dups,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": OP5_SQL,
    "op6_mixing": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op12_jaccard_join": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
