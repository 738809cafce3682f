"""The registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from corpuslint.llm import op1_quality_rules as op1
from corpuslint.llm import op10_ngram_join as op10
from corpuslint.llm import op11_conversation_repair as op11
from corpuslint.llm import op12_spelling_variants as op12
from corpuslint.llm import op13_exact_dedup as op13
from corpuslint.llm import op2_mixing as op2
from corpuslint.llm import op3_license_scan as op3
from corpuslint.llm import op4_lm_scoring as op4
from corpuslint.llm import op5_toxicity as op5
from corpuslint.llm import op6_pseudonyms as op6
from corpuslint.llm import op7_quality_model as op7
from corpuslint.llm import op8_packing as op8
from corpuslint.llm import op9_embedding_dups as op9

QUERIES = {
    "op1_quality_rules": op1.query,
    "op2_mixing": op2.query,
    "op3_license_scan": op3.query,
    "op4_lm_scoring": op4.query,
    "op5_toxicity": op5.query,
    "op6_pseudonyms": op6.query,
    "op7_quality_model": op7.query,
    "op8_packing": op8.query,
    "op9_embedding_dups": op9.query,
    "op10_ngram_join": op10.query,
    "op11_conversation_repair": op11.query,
    "op12_spelling_variants": op12.query,
    "op13_exact_dedup": op13.query,
}
ORACLES: dict[str, str] = {
    "op13_exact_dedup": op13.SQL,
}
