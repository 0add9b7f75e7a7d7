"""Queries of the corpus operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from .bpe import op4_bpe_codec
from .collocations import op13_collocations
from .contamination import op12_decontamination
from .chat import op3_chat_format
from .embedding_join import op2_embedding_dedup
from .langid import op7_language_crf
from .ngram_join import op10_ngram_jaccard
from .periodic import op11_periodic_runs
from .packing import op1_best_fit_packing
from .quality import op6_quality_rules
from .sharding import op8_sharding
from .sql import oracle_sql
from .substring_dedup import op5_substring_dedup
from .va_file import op9_topk_search

__all__ = ["oracle_sql", "queries"]


def queries():
    every = (op1_best_fit_packing, op2_embedding_dedup, op3_chat_format, op4_bpe_codec, op5_substring_dedup, op6_quality_rules, op7_language_crf, op8_sharding, op9_topk_search, op10_ngram_jaccard, op11_periodic_runs, op12_decontamination, op13_collocations)
    return {f.__name__: f for f in every}
