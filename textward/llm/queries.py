"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textward.llm import checks, p1_near_copies, p3_personal, p4_lookalike_pairs, p5_abuse, p6_format_copies, p7_packing, p8_mixing, p9_garbled


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> callable of (session, folder)."""
    return {
        "p1_found": p1_near_copies.found,
        "p3_found": p3_personal.found,
        "p3_masked": p3_personal.masked,
        "p4_found": p4_lookalike_pairs.found,
        "p4_classes": p4_lookalike_pairs.classes,
        "p4_members": p4_lookalike_pairs.members,
        "p5_found": p5_abuse.found,
        "p5_scores": p5_abuse.scores,
        "p5_rates": p5_abuse.rates,
        "p6_found": p6_format_copies.found,
        "p6_groups": p6_format_copies.groups,
        "p7_packing": p7_packing.packing,
        "p7_fill": p7_packing.fill,
        "p8_sequence": p8_mixing.sequence,
        "p8_shares": p8_mixing.shares,
        "p3_leftovers": checks.leftovers,
        "p7_invariants": checks.packing_invariants,
        "p8_invariants": checks.mixing_invariants,
        "p9_found": p9_garbled.found,
        "p9_texts": p9_garbled.texts,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries whose rows SQL can give over whole tables: what must hold of packing, mixing and masking."""
    return {
        "p3_leftovers": "SELECT kind AS record_kind, 0::BIGINT AS planted_left, 0::BIGINT AS altered FROM (VALUES ('request'), ('match')) v(kind)",
        "p7_invariants": """SELECT target_id, (SELECT count(*) FROM documents WHERE text <> '' AND doc_id IS NOT NULL) AS documents,
          0::BIGINT AS overfull, 0::BIGINT AS split_needlessly, 0::BIGINT AS tokens_missing, true AS filled FROM pack_targets""",
        "p8_invariants": "SELECT mix_id, count(*) AS sources, true AS shares_met, true AS repeats_kept FROM mix_targets GROUP BY mix_id",
    }
