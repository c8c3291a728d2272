"""Fusing the hits of a text into one score and a decision.

``matches`` is an ARRAY of STRUCT with signature_id, score, confidence and severity, in match
order, which matters: ties of the highest score go to the later match, and corroboration
weakens with the rank among the other matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Part of the primary severity a corroborating match adds, before confidence and rank.
CORROBORATION = 0.3


@dataclass(frozen=True)
class ScoringPolicy:
    """Thresholds: a score at or above one reaches it."""

    inbound_flag: float = 4.0
    inbound_block: float = 10.0
    outbound_flag: float = 3.0
    outbound_block: float = 7.0


def decision(score: Column, inbound: Column, policy: ScoringPolicy) -> Column:
    """block, flag or allow; where ``inbound`` is null the lower thresholds count."""
    by_side = lambda a, b: F.when(inbound, a).when(~inbound, b).otherwise(min(a, b))
    block = by_side(policy.inbound_block, policy.outbound_block)
    flag = by_side(policy.inbound_flag, policy.outbound_flag)
    return F.when(score >= block, "block").when(score >= flag, "flag").otherwise("allow")


def score_v1(matches: Column) -> Column:
    """Sum of scores; 0 without matches."""
    return F.aggregate(matches, F.lit(0.0), lambda a, m: a + m["score"])


def early_exit(matches: Column, threshold: float) -> Column:
    """Whether the sum of scores reaches the threshold."""
    return score_v1(matches) >= threshold


def score_v2(matches: Column) -> Column:
    """Highest score plus weakening corroboration of other signatures; 0 without matches."""
    kind = "struct<at:int,best:double>"
    first = F.struct(F.lit(-1).alias("at"), F.lit(None).cast("double").alias("best")).cast(kind)
    indexed = F.transform(matches, lambda m, i: F.struct(i.alias("i"), m["score"].alias("score")))
    top = F.aggregate(
        indexed,
        first,
        lambda a, m: F.when(a["best"].isNull() | (m["score"] >= a["best"]), F.struct(m["i"].alias("at"), m["score"].alias("best")).cast(kind)).otherwise(a),
    )
    # bound once: the primary match, then the others in order
    def total(p: Column) -> Column:
        primary = F.get(matches, p["at"])
        others = F.filter(F.transform(matches, lambda m, i: F.struct(i.alias("i"), m.alias("m"))), lambda x: (x["i"] != p["at"]) & (x["m"]["signature_id"] != primary["signature_id"]))
        ranked = F.transform(others, lambda x, r: x["m"]["confidence"] * CORROBORATION * primary["severity"] / (1.0 + r))
        return primary["score"] + F.aggregate(ranked, F.lit(0.0), lambda a, v: a + v)

    out = F.element_at(F.transform(F.array(top), total), 1)
    return F.when(F.size(matches) > 0, out).otherwise(0.0)


def score_result(matches: Column, inbound: Column, policy: ScoringPolicy = ScoringPolicy()) -> Column:
    """STRUCT<total_score, decision, match_count>."""
    total = score_v2(matches)
    return F.struct(total.alias("total_score"), decision(total, inbound, policy).alias("decision"), F.size(matches).alias("match_count"))


def score_v2_rows(hits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, total_score, match_count from one row per hit: the same by windows.

    The number of hits of a text is bounded by the number of signatures, so a window per text is small.
    """
    w = Window.partitionBy(key)
    numbered = hits.withColumn("_ord", F.row_number().over(w.orderBy(*order)))
    top = numbered.withColumn("_top", F.row_number().over(w.orderBy(F.desc("score"), F.desc("_ord"))))
    prim = F.max(F.when(F.col("_top") == 1, F.struct("signature_id", "severity", "score"))).over(w)
    rest = top.withColumn("_p", prim).withColumn("_other", (F.col("_top") != 1) & (F.col("signature_id") != F.col("_p.signature_id")))
    ranked = rest.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_other").orderBy("_ord")) - 1)
    part = F.when(F.col("_other"), F.col("confidence") * CORROBORATION * F.col("_p.severity") / (1.0 + F.col("_r"))).otherwise(0.0)
    return ranked.groupBy(key).agg((F.max("_p.score") + F.sum(part)).alias("total_score"), F.count(F.lit(1)).alias("match_count"))
