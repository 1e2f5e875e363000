"""The training-data queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .ball_trees import OP13_SQL, op13_hard_negatives
from .bsi import OP7_SQL, op7_bit_sliced_topk
from .flac import op3_flac_media
from .language import op5_ppm_language
from .licences import op9_licence_digests, op9_sql
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import OP10_SQL, op10_mix_sources
from .near_dedup import op8_minhash_odd_sketch
from .packing import op4_min_slack_packing
from .part_codes import OP11_SQL, op11_part_codes
from .pii import op1_boosted_pii
from .token_stream import op2_token_stream
from .toxicity import op12_noisy_channel_toxicity

QUERIES = {f.__name__: f for f in (op1_boosted_pii, op2_token_stream, op3_flac_media, op4_min_slack_packing, op5_ppm_language, op6_line_dedup, op7_bit_sliced_topk, op8_minhash_odd_sketch, op9_licence_digests, op10_mix_sources, op11_part_codes, op12_noisy_channel_toxicity, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op6_line_dedup": OP6_SQL, "op7_bit_sliced_topk": OP7_SQL, "op9_licence_digests": op9_sql(), "op10_mix_sources": OP10_SQL, "op11_part_codes": OP11_SQL, "op13_hard_negatives": OP13_SQL}
