"""Scanning a table of texts: normalise, match, score, decide."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.normalize import normalise
from textward.operators import heuristic
from textward.operators.policy import DEFAULT, Policy
from textward.operators.scoring import decision, score_v1, score_v2
from textward.sources.catalog import Catalog, Signature

#: An engine adds a column of further matches: (table with raw text, signatures with points) -> ARRAY<MATCH> column.
Engine = Callable[[DataFrame, str, list[tuple[Signature, float]]], Column]


@dataclass
class Scanner:
    """A catalog and a policy, compiled to one plan.

    ``engines`` maps classifier and semantic to engines; signatures of engines that are missing,
    of composite and of llm-judge add nothing. ``judge`` may add matches to texts whose summed
    score is ambiguous. ``monitor_log`` keeps what a monitor policy drops, in ``logged``.
    """

    catalog: Catalog = field(default_factory=Catalog.load)
    policy: Policy = DEFAULT
    engines: dict[str, Engine] = field(default_factory=dict)
    judge: Callable[[DataFrame, str, str], DataFrame] | None = None
    monitor_log: bool = False

    def signatures(self, direction: str | None, engine: str, action: str = "enforce") -> list[tuple[Signature, float]]:
        """Active signatures of an engine (for any direction, if it is None) whose resolved action is ``action``, with resolved points."""
        out = []
        for s in self.catalog.active(direction) if direction else [s for s in self.catalog.signatures if s.active]:
            if s.engine == engine and self.policy.action(s.id, s.default_action) == action:
                out.append((s, float(int(self.policy.points_of(s.id, s.anomaly_points)))))
        return out

    def scan(self, df: DataFrame, direction: str = "input", text: str = "text") -> DataFrame:
        """Add decision, score, match_count and matches to a table of texts of one direction.

        Narrow: no shuffle. Null and empty texts are allowed with score 0. Columns of the table
        with these names are replaced.
        """
        return self._scan(df, text, direction)

    def scan_both(self, df: DataFrame, direction: str = "direction", text: str = "text") -> DataFrame:
        """Scan a table with a direction column, in one pass.

        A row whose direction is neither input nor output (or is null) meets the signatures of both
        and the lower thresholds, so that no text is allowed unseen.
        """
        named = F.when(F.col(direction).isin("input", "output"), F.col(direction))
        return self._scan(df.withColumn("__side", named), text, None).drop("__side")

    def _scan(self, df: DataFrame, text: str, direction: str | None) -> DataFrame:
        side = None if direction else "__side"
        fixed, logged = self.signatures(direction, "heuristic"), self.signatures(direction, "heuristic", "monitor") if self.monitor_log else []
        out = normalise(df.drop("decision", "score", "match_count", "matches"), text, "__norm")
        out = out.withColumn("__t", F.col("__norm.processed_text")).withColumn("__low", F.lower(F.col("__t")))
        slow = heuristic.slow_patterns([s for s, _ in fixed + logged])
        if slow:
            out = out.withColumn("__slow", heuristic.slow_hits(slow)(F.col("__t")))
        parts = [heuristic.matches(fixed, "__t", "__low", side, slow)]
        for name in ("classifier", "semantic"):
            chosen = self.signatures(direction, name)
            if name in self.engines and chosen:
                found = self.engines[name](out, text, chosen)
                if side:
                    # one run of the engine for both directions; matches of the other one are taken off
                    ids = {d: [s.id for s, _ in chosen if s.direction not in (d, "bidirectional")] for d in ("input", "output")}
                    for d, others in ids.items():
                        if others:
                            kept = F.filter(found, lambda m, o=others: ~m["signature_id"].isin(*o))
                            found = F.when(F.col(side) == d, kept).otherwise(found)
                parts.append(found)
        out = out.withColumn("matches", F.concat(*parts) if len(parts) > 1 else parts[0])
        if self.judge is not None:
            out = self.judge(out, text, "matches")
        if self.monitor_log:
            out = out.withColumn("logged", heuristic.matches(logged, "__t", "__low", side, slow))
        out = out.withColumn("score", score_v2(F.col("matches")))
        inbound = F.lit(direction == "input") if direction else F.col(side) == "input"
        verdict = F.lit("allow") if self.policy.monitor else decision(F.col("score"), inbound, self.policy.scoring)
        out = out.withColumn("decision", verdict).withColumn("match_count", F.size("matches"))
        return out.drop("__norm", "__t", "__low", "__slow")

    def sum_reached(self, matches: Column) -> Column:
        """Whether the plain sum of scores reaches the policy's early exit."""
        return score_v1(matches) >= self.policy.early_exit


def response(scanned: DataFrame, *keys: str) -> DataFrame:
    """keys, decision, score and matches with the five fields a caller sees."""
    seen = ("signature_id", "matched_text", "score", "confidence", "severity")
    shown = F.transform("matches", lambda m: F.struct(*[m[c].alias(c) for c in seen]))
    return scanned.select(*keys, "decision", "score", shown.alias("matches"))


def guarded(inputs: DataFrame, outputs: DataFrame, keys: list[str], block_on_flag: bool = False) -> DataFrame:
    """keys, input_decision, output_decision, decision of guarded calls.

    A blocked input ends the call (its output is not looked at); otherwise the stricter of the
    two stands. With ``block_on_flag`` a flag blocks. Calls without output keep the input's decision.
    """
    a = inputs.select(*keys, F.col("decision").alias("input_decision"))
    b = outputs.select(*keys, F.col("decision").alias("output_decision"))
    both = a.join(b, keys, "left")
    block = (F.col("input_decision") == "block") | F.coalesce(F.col("output_decision") == "block", F.lit(False))
    flag = (F.col("input_decision") == "flag") | F.coalesce(F.col("output_decision") == "flag", F.lit(False))
    stopped = F.when(F.col("input_decision") == "block", F.lit(None).cast("string")).otherwise(F.col("output_decision"))
    verdict = F.when(block, "block").when(flag, "block" if block_on_flag else "flag").otherwise("allow")
    return both.select(*keys, "input_decision", stopped.alias("output_decision"), verdict.alias("decision"))
