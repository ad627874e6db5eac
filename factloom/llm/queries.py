"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from .decontaminate import op1_decontamination
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .filter_audit import OP11_SQL, op11_filter_audit
from .language import op4_language_id
from .ngram_join import op9_ngram_jaccard_join
from .piece_codec import op3_sentencepiece_codec
from .quality import op2_quality_classifier
from .repeats import op6_suffix_dedup
from .resampling import OP13_SQL, op13_importance_resampling
from .secret_scan import op8_secret_scan
from .sharding import op10_hilbert_sharding
from .token_counts import op12_token_counts
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sentencepiece_codec": op3_sentencepiece_codec,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_warc": op7_warc,
    "op8_secret_scan": op8_secret_scan,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_hilbert_sharding": op10_hilbert_sharding,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_counts": op12_token_counts,
    "op13_importance_resampling": op13_importance_resampling,
}

SQL = {
    "op5_exact_dedup": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op11_filter_audit": OP11_SQL,
    "op13_importance_resampling": OP13_SQL,
}
