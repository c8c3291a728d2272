"""Problem 8: documents of several sources mixed to target shares of all tokens.

The whole of a mix is as large as the scarcest source allows: the least, over sources, of
repeats times tokens over share. Each source follows a weight schedule over the training run, given
as points (time, weight) or made here: nearer to the sources' natural sizes at the start and as far
on the other side of the target at the end. Schedules are scaled to a mean of 1, so that the integral
of a source's weight is its target share. A document copy stands where the cumulative demand of its
source reaches the tokens before it; the closed form of that inverse, stretch by stretch, gives its
position, and documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.llm.data import small
from textward.llm.sizes import document_sizes, slices_for
from textward.operators.prefix import order_hash, with_prefix
from textward.session import materialise
from textward.sources.tables import table

#: (mix, source) -> points (time 0..1, weight >= 0) of a source's weight, linear between points.
Schedules = dict[tuple[str, str], list[tuple[float, float]]]
#: A stretch between two points: start, weight there, change of weight a unit of time, demand before it.
STRETCH = "struct<t:double,w:double,s:double,c:double>"
PLAN = f"mix_id string, source string, share double, max_repeats int, source_tokens long, whole double, stretches array<{STRETCH}>"


def stretches(points: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """The stretches of a schedule scaled to mean 1; one of weight 1 where the points give no weight."""
    points = sorted(points)
    if not points or points[0][0] > 0 or points[-1][0] < 1:
        points = [(0.0, points[0][1] if points else 1.0), *points, (1.0, points[-1][1] if points else 1.0)]
    mean = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    if mean <= 0:
        return [(0.0, 1.0, 0.0, 0.0)]
    out, demand = [], 0.0
    for (t0, w0), (t1, w1) in zip(points, points[1:]):
        if t1 > t0:
            out.append((t0, w0 / mean, (w1 - w0) / mean / (t1 - t0), demand))
            demand += (t1 - t0) * (w0 + w1) / 2 / mean
    return out


def schedule(targets: list, tokens: dict[str, int], given: Schedules | None = None) -> list[tuple]:
    """Rows of PLAN for the sources that have tokens.

    Sources without documents can't have a share; the others' shares are scaled up to 1. The
    schedules made here weigh 1 - a at the start and 1 + a at the end, a within -1..1; weighted by
    shares they sum to 1 at any time. Of a source that a mix names twice the last row counts.
    """
    out = []
    mixes: dict[str, dict] = {}
    for r in targets:
        if r.target_share and r.target_share > 0 and tokens.get(r.source) and (r.max_repeats or 0) > 0:
            mixes.setdefault(r.mix_id, {})[r.source] = r
    for mix, rows in sorted(mixes.items()):
        total = sum(r.target_share for r in rows.values())
        natural = sum(tokens[s] for s in rows)
        shares = {s: r.target_share / total for s, r in rows.items()}
        whole = min(r.max_repeats * tokens[s] / shares[s] for s, r in rows.items())
        raw = {s: 1 - tokens[s] / natural / share for s, share in shares.items()}
        scale = 1 / max(1.0, *(abs(v) for v in raw.values()))
        for s, r in rows.items():
            a = raw[s] * scale
            points = (given or {}).get((mix, s), [(0.0, 1 - a), (1.0, 1 + a)])
            out.append((mix, s, shares[s], r.max_repeats, tokens[s], float(whole), stretches(points)))
    return out


def position(demand: Column, listed: Column) -> Column:
    """The time at which the cumulative demand (0..1) of a schedule is reached."""
    x = F.element_at(F.filter(listed, lambda y: y["c"] <= demand), -1)
    left = F.greatest(F.lit(0.0), demand - x["c"])
    root = (F.sqrt(F.greatest(F.lit(0.0), x["w"] * x["w"] + 2 * x["s"] * left)) - x["w"]) / x["s"]
    flat = F.when(x["w"] > 0, left / x["w"]).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x["t"] + F.when(F.abs(x["s"]) < 1e-9, flat).otherwise(root)))


def _plan(spark: SparkSession, folder: str, given: Schedules | None = None) -> tuple[DataFrame, DataFrame]:
    sizes = document_sizes(spark, folder)
    # a bounded table of parameters, so what is named in it may be broadcast
    targets = small(table(spark, folder, "mix_targets").where("mix_id IS NOT NULL AND source IS NOT NULL"))
    named = F.broadcast(spark.createDataFrame([(s,) for s in sorted({r.source for r in targets})], "source string"))
    per_source = small(sizes.join(named, "source").groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")))
    plan = spark.createDataFrame(schedule(targets, {r.source: r.t for r in per_source}, given), PLAN)
    docs = sizes.join(named, "source").withColumn("ord", order_hash("doc_id", F.lit("mix")))
    ranked = with_prefix(docs, ["source"], "ord", ["doc_id"], "n_tokens", slices=slices_for(max([r.n for r in per_source], default=0)))
    return ranked.select("doc_id", "source", "n_tokens", "before"), plan


def _copies(spark: SparkSession, folder: str, given: Schedules | None = None) -> DataFrame:
    ranked, plan = _plan(spark, folder, given)
    both = ranked.join(F.broadcast(plan), "source")
    # a copy belongs to the quota if at least half of it fits; only such copies are made
    quota = F.col("share") * F.col("whole")
    last = F.floor((quota - F.col("n_tokens") / 2 - F.col("before")) / F.col("source_tokens"))
    last = F.least(last, F.col("max_repeats") - 1)
    chosen = both.where(last >= 0).withColumn("copy", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    start = F.col("copy") * F.col("source_tokens") + F.col("before")
    return chosen.withColumn("position", position(F.least(F.lit(1.0), start / quota), F.col("stretches")))


def sequence(spark: SparkSession, folder: str, given: Schedules | None = None) -> DataFrame:
    """mix_id, position (0..1), source, doc_id, copy, n_tokens: the training order of each mix.

    ``given`` holds weight schedules in place of those made here.

    Documents of sources outside a mix, and copies beyond a source's quota, are not in it.
    """
    rows = _copies(spark, folder, given).select("mix_id", "position", "source", "doc_id", "copy", "n_tokens")
    return rows.repartitionByRange("mix_id", "position", "doc_id", "copy").sortWithinPartitions("mix_id", "position", "doc_id", "copy")


def shares(spark: SparkSession, folder: str) -> DataFrame:
    """mix_id, source, target_share, actual_share, tokens, documents, most_copies; absent sources have 0."""
    used = _copies(spark, folder).groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), (F.max("copy") + 1).alias("most_copies"))
    used = materialise(used, "shares")
    whole = used.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    targets = table(spark, folder, "mix_targets").select("mix_id", "source", "target_share")
    rows = targets.join(used, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("mix_id", "source", "target_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_copies").alias("most_copies"))
