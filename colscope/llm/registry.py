"""Queries of this subpackage for ``__spark_entry__``, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op7_bpe
from .decontam import op9_decontamination
from .jaccard import op2_ngram_jaccard
from .kneser_ney import op1_lm_scoring
from .lines import op5_lines
from .quality import op6_quality
from .sharding import op10_sharding
from .substring import op3_substrings
from .suffix import op4_suffixes
from .warc import op8_warc

QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_ngram_jaccard, op3_substrings, op4_suffixes, op5_lines, op6_quality, op7_bpe, op8_warc, op9_decontamination, op10_sharding)}

SQL: dict[str, str] = {}
