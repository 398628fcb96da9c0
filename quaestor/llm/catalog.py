"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, exact_dedup, interpolation, language_id, minhash, mixing, neighbours, pieces, secrets, sharding, toxicity, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bag_minhash": minhash.op1_bag_minhash,
        "op2_deleted_interpolation": interpolation.op2_deleted_interpolation,
        "op3_virtual_slots": sharding.op3_virtual_slots,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_hyperdimensional": language_id.op5_hyperdimensional,
        "op6_source_schedule": mixing.op6_source_schedule,
        "op7_hilbert_curves": neighbours.op7_hilbert_curves,
        "op8_deobfuscation": toxicity.op8_deobfuscation,
        "op9_piece_backtracking": pieces.op9_piece_backtracking,
        "op10_entropy_secrets": secrets.op10_entropy_secrets,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_range_whitening": whitening.op12_range_whitening,
        "op13_blocked_bloom": url_filter.op13_blocked_bloom,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.SQL, "op6_source_schedule": mixing.SQL, "op10_entropy_secrets": secrets.SQL, "op13_blocked_bloom": url_filter.SQL}
