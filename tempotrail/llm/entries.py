"""The queries of this subpackage, and the SQL that some of them can be checked with."""

from __future__ import annotations

from tempotrail.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tempotrail.llm.language import op9_language
from tempotrail.llm.lattice_lm import op5_lattice_lm
from tempotrail.llm.mixing import op4_mixing
from tempotrail.llm.sanitise import op6_sanitise
from tempotrail.llm.sharding import op8_sharding
from tempotrail.llm.simhash import op3_simhash
from tempotrail.llm.substring import OP10_SQL, op10_substring
from tempotrail.llm.warc import OP2_SQL, op2_warc
from tempotrail.llm.winnowing import OP7_SQL, op7_winnowing

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_lattice_lm": op5_lattice_lm,
    "op6_sanitise": op6_sanitise,
    "op7_winnowing": op7_winnowing,
    "op8_sharding": op8_sharding,
    "op9_language": op9_language,
    "op10_substring": op10_substring,
}
ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op7_winnowing": OP7_SQL,
    "op10_substring": OP10_SQL,
}
