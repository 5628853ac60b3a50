"""Queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from .centroids import OP13_SQL, op13_partial_distance
from .exact_dedup import OP9_SQL, op9_exact_dedup
from .katz import OP12_SQL, op12_katz_backoff
from .media import op1_media_sniff
from .mixing import op2_source_mix
from .near_dedup import OP10_SQL, op10_near_dedup
from .negatives import OP11_SQL, op11_hard_negatives
from .packing import op6_harmonic_pack
from .pii import op7_pii_field
from .secrets import op3_secret_scan
from .sstable import op8_token_shards
from .substring_dedup import op4_suffix_dedup
from .toxicity import op5_toxicity_cnn

QUERIES = {f.__name__: f for f in (op1_media_sniff, op2_source_mix, op3_secret_scan, op4_suffix_dedup, op5_toxicity_cnn, op6_harmonic_pack, op7_pii_field, op8_token_shards, op9_exact_dedup, op10_near_dedup, op11_hard_negatives, op12_katz_backoff, op13_partial_distance)}
ORACLE_SQL = {"op9_exact_dedup": OP9_SQL, "op10_near_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_katz_backoff": OP12_SQL, "op13_partial_distance": OP13_SQL}
