"""The operators' queries over the test tables and their SQL."""

from __future__ import annotations

from innsight.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from innsight.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from innsight.llm.language_id import op4_language_id
from innsight.llm.min_max_hash import OP11_SQL, op11_min_max_hash
from innsight.llm.mixing import OP7_SQL, op7_mix_sources
from innsight.llm.ngram_join import OP3_SQL, op3_ngram_jaccard
from innsight.llm.periodic_runs import OP13_SQL, op13_periodic_runs
from innsight.llm.pii import op1_personal_data
from innsight.llm.quality import op5_quality
from innsight.llm.sentencepiece_bpe import op10_sentencepiece
from innsight.llm.substring_dedup import OP9_SQL, op9_substring_dedup
from innsight.llm.toxicity import op2_toxicity
from innsight.llm.vantage_point import OP6_SQL, op6_nearest_vectors

QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_toxicity": op2_toxicity,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_language_id": op4_language_id,
    "op5_quality": op5_quality,
    "op6_nearest_vectors": op6_nearest_vectors,
    "op7_mix_sources": op7_mix_sources,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_min_max_hash": op11_min_max_hash,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES = {
    "op3_ngram_jaccard": OP3_SQL,
    "op6_nearest_vectors": OP6_SQL,
    "op7_mix_sources": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_min_max_hash": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
