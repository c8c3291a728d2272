"""The queries of the scanner, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textward.functions import normalize as n
from textward.operators import sessionize, sessions
from textward.operators.engines import in_band
from textward.operators.heuristic import signature_hit
from textward.operators.policy import MONITOR_ONLY, STRICT, apply_overrides
from textward.operators.scoring import ScoringPolicy, decision, early_exit, score_result, score_v1, score_v2_rows
from textward.operators.timeline import places
from textward.operators.substrings import occurrences
from textward.operators.semantic import PhraseIndex, best_per_signature, hits
from textward.plans import reports
from textward.plans import scan_sql as q
from textward.plans.scan import Scanner, guarded, response
from textward.sources.audit import event_counts, last_events
from textward.sources.catalog import Pattern, Signature, merge_layers
from textward.sources.tables import has_text, spread, table

CONFIDENCES = {"high": 0.90, "medium": 0.70, "low": 0.45}
_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in CONFIDENCES.items())


def once(rows: DataFrame, *names: str) -> DataFrame:
    """request_id and the named columns of the earliest delivery of each request (deliveries repeat text and time)."""
    kept = rows.groupBy("request_id").agg(F.min_by(F.struct(*names), F.struct(F.col("received_at").isNull(), "received_at")).alias("x"))
    return kept.select("request_id", "x.*")


def deliveries(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Every delivery of a request, on all cores: request_id, received_at and the named columns.

    Work on texts is done here, so that only its results go through the shuffle of :func:`once`.
    """
    return spread(table(spark, folder, "scan_requests").select("request_id", "received_at", *columns)).where("request_id IS NOT NULL")


def requests(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each request once. Only the named columns go through the shuffle; all of them if none is named."""
    rows = table(spark, folder, "scan_requests").where("request_id IS NOT NULL")
    return once(rows, *(columns or ("received_at", "session_id", "direction", "source", "text", "ts")))


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """Each match once."""
    return table(spark, folder, "scan_matches").where("match_id IS NOT NULL").dropDuplicates(["match_id"])


REQUESTS_SQL = "requests AS (SELECT request_id, arg_min(session_id, received_at) AS session_id0, arg_min(struct_pack(session_id := session_id, direction := direction, source := source, text := text, ts := ts), received_at) AS x FROM scan_requests WHERE request_id IS NOT NULL GROUP BY request_id)"
MATCHES_SQL = "matches AS (SELECT match_id, any_value(request_id) AS request_id, any_value(match_no) AS match_no, any_value(signature_id) AS signature_id, any_value(score) AS score, any_value(confidence) AS confidence, any_value(severity) AS severity FROM scan_matches WHERE match_id IS NOT NULL GROUP BY match_id)"
SCORED_SQL = """ord AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY match_no, match_id) AS o FROM matches),
 prim AS (SELECT * FROM ord QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, o DESC) = 1),
 rest AS (SELECT o.request_id, o.confidence, p.severity, row_number() OVER (PARTITION BY o.request_id ORDER BY o.o) - 1 AS r FROM ord o JOIN prim p ON o.request_id = p.request_id AND o.o <> p.o AND o.signature_id <> p.signature_id),
 scored AS (SELECT p.request_id, p.score + coalesce((SELECT sum(r.confidence * 0.3 * r.severity / (1.0 + r.r)) FROM rest r WHERE r.request_id = p.request_id), 0.0) AS total,
   (SELECT count(*) FROM ord o WHERE o.request_id = p.request_id) AS n FROM prim p)"""


def _arrays(spark: SparkSession, folder: str) -> DataFrame:
    """request_id, direction, matches in order (a request has few); requests without matches have none."""
    kind = "array<struct<match_no:int,match_id:bigint,signature_id:string,score:double,confidence:double,severity:double>>"
    listed = matches(spark, folder).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("match_no", "match_id", "signature_id", "score", "confidence", "severity"))).alias("matches"))
    both = requests(spark, folder, "direction", "source").join(listed, "request_id", "left")
    return both.withColumn("matches", F.coalesce(F.col("matches"), F.array().cast(kind)))


def _shown(found: DataFrame) -> DataFrame:
    """Score rounded, and the ids of the hits in order."""
    ids = F.array_join(F.transform("matches", lambda m: m["signature_id"]), ",")
    return found.withColumn("score", F.round("score", 6)).withColumn("signatures", ids)


def scan_requests_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every request scanned by the built-in catalog: decision, score and ids of the hits in order."""
    out = Scanner().scan_both(deliveries(spark, folder, "direction", "text"))
    return once(_shown(out), "direction", "decision", "score", "signatures")


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents scanned as outputs: leaks of personal data and secrets."""
    rows = spread(table(spark, folder, "documents").select("doc_id", "text"))
    return _shown(Scanner().scan(rows, "output")).select("doc_id", "decision", "score", "signatures")


def scan_monitor_mode(spark: SparkSession, folder: str) -> DataFrame:
    """A monitor policy: nothing is enforced, so every score is 0 and every decision allow; what would have hit is logged."""
    out = Scanner(policy=MONITOR_ONLY, monitor_log=True).scan_both(deliveries(spark, folder, "direction", "text"))
    ids = F.array_join(F.transform("logged", lambda m: m["signature_id"]), ",")
    return once(out.withColumn("match_count", F.size("matches")).withColumn("logged", ids), "decision", "score", "match_count", "logged")


def scan_response_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The response rows of inputs and outputs: one per match, with the five fields a caller sees."""
    out = once(Scanner().scan_both(deliveries(spark, folder, "direction", "text")), "decision", "score", "matches")
    return response(out, "request_id").select("request_id", "decision", F.posexplode("matches").alias("pos", "m")).select("request_id", "decision", "pos", "m.*")


def scan_hits(spark: SparkSession, folder: str) -> DataFrame:
    """One row per request and signature that hits, with the place of the match in the scanned text, in bytes."""
    out = once(Scanner().scan_both(deliveries(spark, folder, "direction", "text")), "matches")
    return out.select("request_id", F.explode("matches").alias("m")).select("request_id", *(f"m.{c}" for c in HIT_FIELDS))


HIT_FIELDS = ("signature_id", "matched_text", "match_offset", "match_length", "score")


def signature_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Every heuristic signature with its hits in requests, matched texts, phrases, documents and the catalog's examples, as both directions.

    Signatures without a hit have a row too.
    """
    scanner = Scanner()
    signatures = [s for s, _ in scanner.signatures(None, "heuristic")]
    examples = spark.createDataFrame([(s.example,) for s in signatures], "text string")
    phrases = table(spark, folder, "signature_patterns").select(F.explode("reference_phrases").alias("text"))
    parts = (
        ("request", table(spark, folder, "scan_requests").select("text")),
        ("match", table(spark, folder, "scan_matches").select(F.col("matched_text").alias("text"))),
        ("phrase", phrases),
        ("document", table(spark, folder, "documents").select("text")),
        ("example", examples),
    )
    texts = parts[0][1].limit(0).withColumn("kind", F.lit(""))
    for kind, rows in parts:
        texts = texts.unionByName(spread(rows).withColumn("kind", F.lit(kind)))
    out = scanner.scan_both(texts.withColumn("direction", F.lit(None).cast("string")))
    # the outer form, since Spark puts a filter with all patterns once more below the other
    out = out.select("kind", F.explode_outer("matches").alias("m")).where("m IS NOT NULL")
    counts = out.groupBy(F.col("m.signature_id").alias("signature_id")).agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k, _ in parts],
        F.sum("m.match_offset").alias("offsets"),
        F.sum("m.match_length").alias("lengths"),
    )
    names = spark.createDataFrame([(s.id,) for s in signatures], "signature_id string")
    return names.join(counts, "signature_id", "left").na.fill(0)


def strip_invisible(spark: SparkSession, folder: str) -> DataFrame:
    rows = requests(spark, folder, "text").where("text IS NOT NULL")
    return rows.select("request_id", n.strip_invisible(F.col("text")).alias("stripped"), n.count_of(F.col("text"), n.INVISIBLE).cast("long").alias("removed"), n.count_of(F.col("text"), n.BIDI).cast("long").alias("bidi"), n.count_of(F.col("text"), n.ZERO_WIDTH).cast("long").alias("zero_width"))


def map_lookalikes(spark: SparkSession, folder: str) -> DataFrame:
    rows = requests(spark, folder, "text").where("text IS NOT NULL")
    mapped = n.map_lookalikes(F.col("text"))
    return rows.select("request_id", mapped.alias("mapped"), (mapped != F.col("text")).alias("changed"))


def rot13(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder, "text").where("text IS NOT NULL").select("request_id", n.rot13(F.col("text")).alias("turned"), n.looks_english(F.col("text")).alias("english"))


def normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Every request through the whole normaliser."""
    out = n.normalise(deliveries(spark, folder, "text")).select("request_id", "received_at", "norm.*")
    out = out.withColumn("encodings", F.array_join("encodings_found", ","))
    return once(out, "processed_text", "encodings", "invisible_chars_removed", "homoglyphs_mapped", "was_truncated")


def unicode_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Invisible characters, disguises, overrides of direction and the plain form of every request."""
    rows = deliveries(spark, folder, "text").where("text IS NOT NULL")
    out = rows.select("request_id", "received_at", n.unicode_analysis(F.col("text")).alias("u")).select("request_id", "received_at", "u.*")
    return once(out, "invisible_chars", "homoglyphs_detected", "bidi_overrides", "zero_width_chars", "normalized_text")


def _encoded(spark: SparkSession, folder: str, how) -> DataFrame:
    rows = deliveries(spark, folder, "text").where("text IS NOT NULL")
    out = rows.select("request_id", "received_at", how(F.col("text")).alias("e")).withColumn("d", n.decode(F.col("e")))
    return once(out.withColumn("decoded", F.col("d.t")).withColumn("encodings", F.array_join("d.enc", ",")), "decoded", "encodings")


def decode_base64(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded twice and decoded again; texts too short to be told from words stay encoded."""
    packed = lambda t: F.regexp_replace(F.base64(F.encode(t, "UTF-8")), r"\s", "")
    return _encoded(spark, folder, lambda t: packed(packed(t)))


def decode_hex(spark: SparkSession, folder: str) -> DataFrame:
    """Every text as hexadecimal digits, decoded again; fewer than eight digits are not taken for an encoding."""
    return _encoded(spark, folder, lambda t: F.hex(F.encode(t, "UTF-8")))


def entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy of every request's bytes, and whether it is unusual; 0 for null and empty texts."""
    rows = deliveries(spark, folder, "text")
    out = rows.select("request_id", "received_at", F.octet_length(F.coalesce("text", F.lit(""))).alias("b"), n.entropy(F.col("text")).alias("e"))
    out = out.withColumn("entropy", F.round("e", 6)).withColumn("abnormal", (F.col("b") >= 20) & ((F.col("e") < 3.0) | (F.col("e") > 4.5)))
    return once(out, "entropy", "abnormal")


def substring_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """request_id, signature_id of the catalog's literal patterns in the requests, ASCII case folded.

    The catalog (a fixed table) is compiled into the plan, so the texts are read once and not joined.
    """
    rules = table(spark, folder, "signature_patterns").where("pattern_type = 'substring' AND pattern_value <> ''").select("signature_id", "pattern_value").orderBy("signature_id", "pattern_id").collect()
    rows = deliveries(spark, folder, "text").where("text IS NOT NULL")
    low = rows.withColumn("low", F.translate("text", ASCII_UPPER, ASCII_UPPER.lower()))
    tests = [f"IF(contains(low, {n.sql_string(r.pattern_value.translate(_LOWER))}), {n.sql_string(r.signature_id)}, NULL)" for r in rules]
    found = F.expr(f"array_distinct(array_compact(array({', '.join(tests)})))") if tests else F.array().cast("array<string>")
    return once(low.withColumn("found", found), "found").select("request_id", F.explode("found").alias("signature_id"))


def substring_places(spark: SparkSession, folder: str) -> DataFrame:
    """Places of the catalog's literal patterns in every request, without overlaps: index, text, byte offset and length."""
    rules = _literals(spark, folder)
    rows = deliveries(spark, folder, "text").where("text IS NOT NULL")
    found = once(rows.withColumn("found", occurrences(F.col("text"), rules)), "found").select("request_id", F.explode("found").alias("m"))
    return found.select("request_id", "m.*")


def _literals(spark: SparkSession, folder: str) -> list[str]:
    """The catalog's literals in order, each once; a fixed table of signatures, so few."""
    rules = table(spark, folder, "signature_patterns").where("pattern_type = 'substring' AND pattern_value <> ''")
    return [r.v for r in rules.select(F.lower("pattern_value").alias("v")).distinct().orderBy("v").collect()]


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = {c: c + 32 for c in range(65, 91)}


def condition_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """request_id, any_hit, all_hit: one made-up signature with three words, under both conditions."""
    words = ("ticket", "project", "table")
    make = lambda condition: Signature("X-1", "words", "1", "agentic", "x", "x", "low", "high", "low", "heuristic", "input", condition, 1, True, True, "enforce", patterns=tuple(Pattern("substring", w) for w in words))
    rows = requests(spark, folder, "text").where(has_text(F.col("text"))).select("request_id", "text", F.lower("text").alias("low"))
    return rows.select("request_id", F.expr(signature_hit(make("any"), "text", "low")).isNotNull().alias("any_hit"), F.expr(signature_hit(make("all"), "text", "low")).isNotNull().alias("all_hit"))


def additive_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = _arrays(spark, folder)
    total = score_v1(F.col("matches"))
    old = ScoringPolicy(5.0, 15.0, 5.0, 10.0)
    return rows.select("request_id", F.round(total, 6).alias("total"), decision(F.round(total, 6), F.col("direction") == "input", old).alias("decision"), early_exit(F.col("matches"), 13.0).alias("early_exit"), in_band(F.col("matches")).alias("judged"))


def fused_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Score, decision and match count of every request under the default policy."""
    rows = _arrays(spark, folder)
    r = score_result(F.col("matches"), F.col("direction") == "input")
    return rows.withColumn("r", r).select("request_id", F.round("r.total_score", 6).alias("score"), F.col("r.decision").alias("decision"), F.col("r.match_count").alias("match_count"))


def fused_scores_strict(spark: SparkSession, folder: str) -> DataFrame:
    rows = _arrays(spark, folder)
    r = score_result(F.col("matches"), F.col("direction") == "input", STRICT.scoring)
    return rows.withColumn("r", r).select("request_id", F.round("r.total_score", 6).alias("score"), F.col("r.decision").alias("decision"))


def fused_scores_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The relational form of the score, for requests with matches."""
    return score_v2_rows(matches(spark, folder), "request_id", ["match_no", "match_id"]).select("request_id", F.round("total_score", 6).alias("score"), "match_count")


def policy_overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Hits with the action and points an override table gives; overrides: low severity is monitored, critical counts 15."""
    s = table(spark, folder, "signatures")
    over = s.where("severity IN ('low', 'critical')").select("signature_id", F.when(F.col("severity") == "low", "monitor").otherwise("default").alias("override_action"), F.when(F.col("severity") == "critical", 15).alias("override_points"))
    found = matches(spark, folder).join(s.select("signature_id", "default_action", "anomaly_points", F.col("confidence").alias("level")), "signature_id")
    out = apply_overrides(found, F.broadcast(over))
    c = F.coalesce(F.create_map(*[x for k, v in CONFIDENCES.items() for x in (F.lit(k), F.lit(v))])[F.col("level")], F.lit(0.70))
    return out.where("action = 'enforce'").select("match_id", "signature_id", "points", F.round(c * F.col("points"), 6).alias("enforced_score"))


def signature_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Active signatures per scan direction and engine; bidirectional ones count for both."""
    s = table(spark, folder, "signatures").where("is_enabled AND default_enabled")
    both = s.withColumn("scan_direction", F.explode(F.when(F.col("direction") == "bidirectional", F.array(F.lit("input"), F.lit("output"))).otherwise(F.array("direction"))))
    return both.groupBy("scan_direction", "engine").agg(F.count(F.lit(1)).alias("signatures"), F.array_join(F.array_sort(F.collect_list("signature_id")), ",").alias("ids"))


def signature_listing(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "signatures")
    return s.select("signature_id", "signature_name", "category", "severity", "engine", "direction", "anomaly_points", "default_action", F.col("default_enabled").alias("enabled"))


def signature_detail(spark: SparkSession, folder: str) -> DataFrame:
    """The sixteen columns of a signature's detail; signatures without tags have an empty list."""
    s = table(spark, folder, "signatures")
    names = ("signature_id", "signature_name", "signature_version", "category", "engine", "severity", "direction", "anomaly_points")
    rest = ("subcategory", "technique", "confidence", "performance_cost", "match_condition", "default_action")
    return s.select(*names, F.col("default_enabled").alias("enabled"), *rest, F.array_join(F.coalesce("tags", F.array()), ",").alias("tags"))


def signature_layers(spark: SparkSession, folder: str) -> DataFrame:
    """A custom layer over the catalog: critical signatures are raised by a point, and a new one is added."""
    base = table(spark, folder, "signatures").select("signature_id", "category", "anomaly_points")
    over = table(spark, folder, "signatures").where("severity = 'critical'").select("signature_id", "category", (F.col("anomaly_points") + 1).alias("anomaly_points"))
    new = spark.createDataFrame([("NEW-001", "agentic", 5)], "signature_id string, category string, anomaly_points int")
    return merge_layers(base, over.unionByName(new))


def _index(spark: SparkSession, folder: str) -> PhraseIndex:
    """The first five vectors of each label are its phrases (labels are few and fixed)."""
    v = table(spark, folder, "embeddings")
    first = v.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("r <= 5")
    return PhraseIndex.from_frame(first, "vec_id", "label", "embedding")


def semantic_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, rank, phrase_id, similarity of the ten nearest phrases of every vector."""
    rows = table(spark, folder, "embeddings").withColumn("n", F.explode(_index(spark, folder).nearest("embedding")))
    return rows.select("vec_id", F.col("n.rank").alias("rank"), F.col("n.phrase_id").alias("phrase_id"), F.round("n.similarity", 5).alias("similarity"))


def semantic_best(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, label, similarity: the best of the ten neighbours per label."""
    rows = table(spark, folder, "embeddings").withColumn("neighbours", _index(spark, folder).nearest("embedding"))
    return best_per_signature(rows, "vec_id").select("vec_id", "label", F.round("similarity", 5).alias("similarity"))


def semantic_hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").withColumn("neighbours", _index(spark, folder).nearest("embedding"))
    return hits(rows, {"0": 0.55, "1": 0.60}, "vec_id").select("vec_id", "signature_id", "matched_text")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    scored = table(spark, folder, "scan_responses").select("request_id", "score")
    return requests(spark, folder, "session_id", "ts").join(scored, "request_id", "left")


def session_states(spark: SparkSession, folder: str) -> DataFrame:
    """State at the end of each session life."""
    out = sessions.fold(_turns(spark, folder), signatures=None)
    return out.select("session_id", F.col("life").cast("long").alias("life"), F.col("turn_count").cast("long").alias("turn_count"), F.round("cumulative_score", 6).alias("cumulative_score"), "last_accessed")


def session_running(spark: SparkSession, folder: str) -> DataFrame:
    """Cumulative score after each turn."""
    out = sessions.running(_turns(spark, folder))
    return out.select("session_id", "request_id", F.col("life").cast("long").alias("life"), F.col("turn").cast("long").alias("turn"), F.round("cumulative_score", 6).alias("cumulative_score"))


def session_history(spark: SparkSession, folder: str) -> DataFrame:
    """Signatures a session life has matched, oldest first, the newest 500 kept."""
    found = matches(spark, folder).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("match_no", "match_id", "signature_id"))), lambda x: x["signature_id"]).alias("signatures"))
    out = sessions.fold(_turns(spark, folder).join(found, "request_id", "left"))
    return out.select("session_id", F.col("life").cast("long").alias("life"), F.size("matched_signatures").cast("long").alias("kept"), F.array_join("matched_signatures", ",").alias("signatures"))


EARLIEST = "0001-01-01"


def guarded_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs and outputs of a session paired by their number: the decision of each guarded call."""
    d = requests(spark, folder, "session_id", "direction", "ts").where("session_id IS NOT NULL").join(table(spark, folder, "scan_responses").select("request_id", "decision"), "request_id")
    d = places(d.withColumn("ts", F.coalesce("ts", F.lit(EARLIEST).cast("timestamp_ntz"))), ["session_id", "direction"], "ts", "request_id").withColumnRenamed("rank", "call")
    return guarded(d.where("direction = 'input'"), d.where("direction = 'output'"), ["session_id", "call"])


def _store(spark: SparkSession, folder: str) -> DataFrame:
    """The last life of every session as a store; sessions named with an even number of letters have a longer time-out."""
    lives = sessions.fold(_turns(spark, folder), signatures=None)
    last = lives.groupBy("session_id").agg(F.max(F.struct("life", "turn_count", "cumulative_score", "last_accessed")).alias("x"))
    ttl = F.when(F.length("session_id") % 2 == 0, 86400).otherwise(1800)
    return last.select("session_id", F.col("x.turn_count").cast("long").alias("turn_count"), F.round("x.cumulative_score", 6).alias("cumulative_score"), "x.last_accessed", ttl.alias("ttl"))


def session_created(spark: SparkSession, folder: str) -> DataFrame:
    """A store with room for three more sessions, after one is asked for in the name of every source and every session is asked for again."""
    asked = requests(spark, folder, "session_id", "source", "ts").where("ts IS NOT NULL")
    by_source = asked.where("source IS NOT NULL").groupBy(F.concat(F.lit("new-"), "source").alias("session_id")).agg(F.min("ts").alias("at"))
    again = asked.where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("ts").alias("at"))
    states = _store(spark, folder)
    out = sessions.create(states, by_source.unionByName(again), limit=sessions.count(states) + 3)
    return out.withColumn("ttl", F.col("ttl").cast("long"))


def session_deleted(spark: SparkSession, folder: str) -> DataFrame:
    """A store without the sessions in which something was blocked."""
    blocked = requests(spark, folder, "session_id").join(table(spark, folder, "scan_responses").where("decision = 'block'").select("request_id"), "request_id")
    return sessions.delete(_store(spark, folder), blocked.where("session_id IS NOT NULL")).withColumn("ttl", F.col("ttl").cast("long"))


def session_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of a store, and what a clean-up removes, an hour after its last use; each session has its own time-out."""
    states = _store(spark, folder)
    now = F.lit(states.agg((F.max("last_accessed") + F.expr("INTERVAL 1 HOUR")).alias("now")).first().now)
    kept = sessions.clean(states, now).select("session_id", "turn_count", F.lit("kept").alias("what"))
    return kept.unionByName(sessions.expired(states, now).select("session_id", "turn_count", F.lit("removed").alias("what")))


def hits_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return reports.hits_rollup(matches(spark, folder), F.broadcast(table(spark, folder, "signatures")))


def top_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_signatures(matches(spark, folder)).select("signature_id", "hits", F.round("score", 4).alias("score"))


def decision_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = requests(spark, folder, "source", "direction").join(table(spark, folder, "scan_responses").select("request_id", "decision"), "request_id")
    return reports.decision_rates(rows, "source", "direction").withColumn("block_rate", F.round("block_rate", 6))


def audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return event_counts(table(spark, folder, "audit_log").where("audit_id IS NOT NULL").dropDuplicates(["audit_id"]))


def audit_last(spark: SparkSession, folder: str) -> DataFrame:
    """The newest hundred events of a category."""
    rows = table(spark, folder, "audit_log").where("audit_id IS NOT NULL").dropDuplicates(["audit_id"])
    return last_events(rows, "event_ts", "audit_id", "scan").select("audit_id", "audit_action", "event_ts")


#: The events of each caller, as SQL (see sessionize.audit_events).
EVENTS_SQL = r"""
 once AS (SELECT audit_id, arg_min(struct_pack(event_ts := event_ts, key_prefix := key_prefix, ip := ip), ingested_at) AS x FROM audit_log GROUP BY audit_id),
 named AS (SELECT audit_id, x.event_ts AS ts,
   CASE WHEN trim(coalesce(x.key_prefix, '')) <> '' THEN trim(x.key_prefix)
        WHEN trim(coalesce(x.ip, '')) <> '' THEN regexp_replace(lower(trim(x.ip)), '^::ffff:(\d+\.\d+\.\d+\.\d+)$', '\1') END AS actor FROM once),
 events AS (SELECT actor, ts, audit_id FROM named WHERE actor IS NOT NULL AND ts IS NOT NULL),
 marked AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY actor ORDER BY ts, audit_id)),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY actor ORDER BY ts, audit_id ROWS UNBOUNDED PRECEDING) AS s FROM marked),
 bounds AS (SELECT *, min(ts) OVER (PARTITION BY actor, s) AS lo, max(ts) OVER (PARTITION BY actor, s) AS hi FROM numbered)"""
STORE_SQL = """store AS (SELECT session_id, max(turn) AS turn_count, round(sum(coalesce(score, 0.0)), 6) AS cumulative_score, max(ts) AS last_accessed,
   CASE WHEN length(session_id) % 2 = 0 THEN 86400 ELSE 1800 END::BIGINT AS ttl FROM turns GROUP BY session_id, life QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY life DESC) = 1)"""
TURNS_SQL = f"""{REQUESTS_SQL},
 t0 AS (SELECT r.request_id, r.x.session_id AS session_id, r.x.ts AS ts, p.score FROM requests r LEFT JOIN scan_responses p USING (request_id) WHERE r.x.session_id IS NOT NULL AND r.x.ts IS NOT NULL),
 t1 AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, request_id) >= 1800000000 THEN 1 ELSE 0 END AS f FROM t0),
 t2 AS (SELECT *, CAST(sum(f) OVER (PARTITION BY session_id ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS life FROM t1),
 turns AS (SELECT *, row_number() OVER (PARTITION BY session_id, life ORDER BY ts, request_id) AS turn FROM t2 QUALIFY turn <= 200)"""
PHRASES_SQL = """phrases AS (SELECT vec_id AS phrase_id, CAST(label AS VARCHAR) AS label, embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 5),
 near AS (SELECT e.vec_id, p.phrase_id, p.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) AS sim FROM embeddings e, phrases p),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, phrase_id) AS rank FROM near QUALIFY rank <= 10)"""


def _text_sql(body: str) -> str:
    return f"WITH {REQUESTS_SQL} SELECT request_id, {body} FROM (SELECT request_id, x.text AS text FROM requests) WHERE text IS NOT NULL"


def _scan_sql(scanner: Scanner, source: str, direction: str | None, final: str, action: str = "enforce") -> str:
    """The scanner as SQL over a CTE ``src`` (key, text, side)."""
    chosen = scanner.signatures(direction, "heuristic", action)
    scored = """matches AS (SELECT key AS request_id, ord AS match_no, ord AS match_id, signature_id, score, confidence, severity FROM hits), """ + SCORED_SQL
    ids = "ids AS (SELECT key, string_agg(signature_id, ',' ORDER BY ord) AS signatures FROM hits GROUP BY key)"
    return f"WITH {source}, {q.normal_ctes('src')}, {q.hit_ctes(chosen, 'src')}, {scored}, {ids} {final}"


def _scan_oracles() -> dict[str, str]:
    src = "src AS MATERIALIZED (SELECT request_id AS key, x.text AS text, CASE WHEN x.direction IN ('input', 'output') THEN x.direction END AS side, x.direction AS direction FROM requests)"
    requests_, docs = f"{REQUESTS_SQL}, {src}", "src AS MATERIALIZED (SELECT doc_id AS key, text, 'output' AS side FROM documents)"
    total = "coalesce(p.total, 0.0)"
    limit = lambda a, b: f"CASE side WHEN 'input' THEN {a} WHEN 'output' THEN {b} ELSE {min(a, b)} END"
    verdict = f"CASE WHEN {total} >= {limit(10.0, 7.0)} THEN 'block' WHEN {total} >= {limit(4.0, 3.0)} THEN 'flag' ELSE 'allow' END AS decision"
    shown = f"{verdict}, round({total}, 6) AS score, coalesce(i.signatures, '') AS signatures FROM src s LEFT JOIN scored p ON p.request_id = s.key LEFT JOIN ids i ON i.key = s.key"
    scanner, watching = Scanner(), Scanner(policy=MONITOR_ONLY)
    chosen = [s for s, _ in scanner.signatures(None, "heuristic")]
    kinds = {"request": "SELECT text FROM scan_requests", "match": "SELECT matched_text AS text FROM scan_matches", "phrase": "SELECT unnest(reference_phrases) AS text FROM signature_patterns", "document": "SELECT text FROM documents", "example": "SELECT * FROM (VALUES " + ", ".join(f"({q.quote(s.example)})" for s in chosen) + ") v(text)"}
    union = " UNION ALL ".join(f"SELECT '{k}' AS kind, text FROM ({body})" for k, body in kinds.items())
    every = f"src AS MATERIALIZED (SELECT row_number() OVER () AS key, kind, text, NULL::VARCHAR AS side FROM ({union}))"
    counts = ", ".join(f"count(h.key) FILTER (WHERE s.kind = '{k}') AS {k}s" for k in kinds)
    ids = ", ".join(f"({q.quote(s.id)})" for s in chosen)
    return {
        "scan_requests_decisions": _scan_sql(scanner, requests_, None, f"SELECT s.key AS request_id, s.direction, {shown}"),
        "scan_documents": _scan_sql(scanner, docs, "output", f"SELECT s.key AS doc_id, {shown}"),
        "scan_monitor_mode": _scan_sql(
            watching, requests_, None, "SELECT s.key AS request_id, 'allow' AS decision, 0.0::DOUBLE AS score, 0 AS match_count, coalesce(i.signatures, '') AS logged FROM src s LEFT JOIN ids i ON i.key = s.key", "monitor"
        ),
        "scan_response_fields": _scan_sql(
            scanner, requests_, None, f"SELECT s.key AS request_id, {verdict}, CAST(row_number() OVER (PARTITION BY s.key ORDER BY h.ord) - 1 AS INTEGER) AS pos, h.signature_id, h.matched_text, h.score, h.confidence, h.severity FROM src s JOIN hits h ON h.key = s.key JOIN scored p ON p.request_id = s.key"
        ),
        "scan_hits": _scan_sql(scanner, requests_, None, f"SELECT key AS request_id, {', '.join(HIT_FIELDS)} FROM hits"),
        "signature_activity": _scan_sql(
            scanner, every, None, f"SELECT v.signature_id, {counts}, CAST(coalesce(sum(h.match_offset), 0) AS BIGINT) AS offsets, CAST(coalesce(sum(h.match_length), 0) AS BIGINT) AS lengths FROM (VALUES {ids}) v(signature_id) LEFT JOIN hits h ON h.signature_id = v.signature_id LEFT JOIN src s ON s.key = h.key GROUP BY v.signature_id"
        ),
        "normalised": f"WITH {requests_}, {q.normal_ctes('src')} SELECT key AS request_id, t AS processed_text, array_to_string(enc, ',') AS encodings, invisible AS invisible_chars_removed, mapped AS homoglyphs_mapped, truncated AS was_truncated FROM norm",
        "unicode_analysis": f"WITH {requests_}, given AS (SELECT key, text FROM src WHERE text IS NOT NULL), {q.nfkc_ctes('given', 'text', 'f')} SELECT key AS request_id, {q.count_of('text', n.INVISIBLE)} AS invisible_chars, {q.stripped('form')} <> text AND regexp_matches(text, '[^\\x00-\\x7F]') AS homoglyphs_detected, {q.count_of('text', n.BIDI)} AS bidi_overrides, {q.count_of('text', n.ZERO_WIDTH)} AS zero_width_chars, {q.stripped('form')} AS normalized_text FROM given JOIN f USING (key)",
        "decode_base64": f"WITH {requests_}, coded AS (SELECT key, to_base64(encode(to_base64(encode(text)))) AS t FROM src WHERE text IS NOT NULL), {q.decode_ctes('coded', 'd')} SELECT key AS request_id, t AS decoded, array_to_string(enc, ',') AS encodings FROM d",
        "decode_hex": f"WITH {requests_}, coded AS (SELECT key, hex(encode(text)) AS t FROM src WHERE text IS NOT NULL), {q.decode_ctes('coded', 'd')} SELECT key AS request_id, t AS decoded, array_to_string(enc, ',') AS encodings FROM d",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> callable of (session, folder)."""
    named = (
        scan_requests_decisions, scan_documents, scan_monitor_mode, scan_response_fields, scan_hits, signature_activity, strip_invisible, map_lookalikes, rot13,
        normalised, unicode_analysis, decode_base64, decode_hex, entropy,
        substring_signatures, condition_signatures, additive_scores, fused_scores, fused_scores_strict, fused_scores_windows, policy_overrides, signature_routing, signature_listing,
        signature_layers, signature_detail, substring_places, session_created, session_deleted, session_cleaned, semantic_neighbours, semantic_best, semantic_hits, session_states, session_running, session_history, guarded_calls, hits_rollup, top_signatures,
        decision_rates, audit_counts, audit_last,
    )
    return {f.__name__: f for f in named} | {"p2_found": sessionize.found, "p2_sessions": sessionize.sessions, "p2_gap_settings": sessionize.gap_settings}


def oracle_sql() -> dict[str, str]:
    """SQL with the same result, by query name."""
    verdict = "CASE WHEN {s} >= CASE WHEN d = 'input' THEN {ib} ELSE {ob} END THEN 'block' WHEN {s} >= CASE WHEN d = 'input' THEN {i} ELSE {o} END THEN 'flag' ELSE 'allow' END"
    fused = f"WITH {REQUESTS_SQL}, {MATCHES_SQL}, {SCORED_SQL}, all_scored AS (SELECT r.request_id, r.x.direction AS d, coalesce(s.total, 0.0) AS total, coalesce(s.n, 0) AS n FROM requests r LEFT JOIN scored s USING (request_id)) "
    base = verdict.format(s="total", ib=10.0, ob=7.0, i=4.0, o=3.0)
    strict = verdict.format(s="total", ib=7.0, ob=5.0, i=2.5, o=2.0)
    old = verdict.format(s="round(total, 6)", ib=15.0, ob=10.0, i=5.0, o=5.0)
    folded = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return _scan_oracles() | {
        "strip_invisible": _text_sql(f"translate(text, {q.quote(n.INVISIBLE)}, '') AS stripped, {q.count_of("text", n.INVISIBLE)} AS removed, {q.count_of("text", n.BIDI)} AS bidi, {q.count_of("text", n.ZERO_WIDTH)} AS zero_width"),
        "map_lookalikes": _text_sql(f"{q.lookalikes('text')} AS mapped, {q.lookalikes('text')} <> text AS changed"),
        "rot13": _text_sql(f"{q.rot13('text')} AS turned, {q.ENGLISH.format('text')} AS english"),
        "entropy": f"WITH {REQUESTS_SQL}, e AS (SELECT request_id, octet_length(encode(coalesce(x.text, ''))) AS b, coalesce(list_aggregate(regexp_extract_all(hex(encode(x.text)), '..'), 'entropy'), 0.0) AS e FROM requests) SELECT request_id, round(e, 6) AS entropy, b >= 20 AND (e < 3.0 OR e > 4.5) AS abnormal FROM e",
        "substring_signatures": f"WITH {REQUESTS_SQL} SELECT DISTINCT r.request_id, p.signature_id FROM requests r, signature_patterns p WHERE p.pattern_type = 'substring' AND p.pattern_value <> '' AND contains({folded.format('r.x.text')}, {folded.format('p.pattern_value')})",
        "condition_signatures": _text_sql("(contains(lower(text), 'ticket') OR contains(lower(text), 'project') OR contains(lower(text), 'table')) AS any_hit, (contains(lower(text), 'ticket') AND contains(lower(text), 'project') AND contains(lower(text), 'table')) AS all_hit") + r" AND regexp_matches(text, '[^\s\p{Z}]')",
        "additive_scores": f"WITH {REQUESTS_SQL}, {MATCHES_SQL}, sums AS (SELECT r.request_id, r.x.direction AS d, coalesce((SELECT sum(m.score) FROM matches m WHERE m.request_id = r.request_id), 0.0) AS total FROM requests r) SELECT request_id, round(total, 6) AS total, {old} AS decision, total >= 13.0 AS early_exit, total BETWEEN 4.0 AND 9.0 AS judged FROM sums",
        "fused_scores": fused + f"SELECT request_id, round(total, 6) AS score, {base} AS decision, n AS match_count FROM all_scored",
        "fused_scores_strict": fused + f"SELECT request_id, round(total, 6) AS score, {strict} AS decision FROM all_scored",
        "fused_scores_windows": f"WITH {MATCHES_SQL}, {SCORED_SQL} SELECT request_id, round(total, 6) AS score, n AS match_count FROM scored",
        "policy_overrides": f"WITH {MATCHES_SQL} SELECT m.match_id, m.signature_id, CASE WHEN s.severity = 'critical' THEN 15 ELSE s.anomaly_points END AS points, round(CASE s.confidence {_CASE} ELSE 0.70 END * CASE WHEN s.severity = 'critical' THEN 15 ELSE s.anomaly_points END, 6)::DOUBLE AS enforced_score FROM matches m JOIN signatures s USING (signature_id) WHERE CASE WHEN s.severity = 'low' THEN 'monitor' ELSE s.default_action END = 'enforce'",
        "signature_routing": "SELECT d AS scan_direction, engine, count(*) AS signatures, string_agg(signature_id, ',' ORDER BY signature_id) AS ids FROM (SELECT *, unnest(CASE WHEN direction = 'bidirectional' THEN ['input', 'output'] ELSE [direction] END) AS d FROM signatures WHERE is_enabled AND default_enabled) GROUP BY d, engine",
        "signature_listing": "SELECT signature_id, signature_name, category, severity, engine, direction, anomaly_points, default_action, default_enabled AS enabled FROM signatures",
        "signature_detail": "SELECT signature_id, signature_name, signature_version, category, engine, severity, direction, anomaly_points, default_enabled AS enabled, subcategory, technique, confidence, performance_cost, match_condition, default_action, array_to_string(coalesce(tags, []), ',') AS tags FROM signatures",
        "substring_places": f"""WITH RECURSIVE {REQUESTS_SQL},
          lit AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT lower(pattern_value) AS v FROM signature_patterns WHERE pattern_type = 'substring' AND pattern_value <> '')),
          low AS (SELECT request_id, x.text AS text, {folded.format('x.text')} AS low FROM requests WHERE x.text IS NOT NULL),
          cand AS (SELECT request_id, text, low, v, i FROM low, lit WHERE contains(low, v)),
          occ AS (SELECT request_id, text, i, p AS s, p + length(v) AS e FROM (SELECT *, unnest(range(1, length(low) - length(v) + 2)) AS p FROM cand) WHERE substring(low, p, length(v)) = v),
          taken AS (SELECT request_id, text, i, s, e FROM occ QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY e, s) = 1
            UNION ALL SELECT o.request_id, o.text, o.i, o.s, o.e FROM (SELECT o.*, row_number() OVER (PARTITION BY o.request_id ORDER BY o.e, o.s) AS r FROM occ o JOIN taken t ON o.request_id = t.request_id AND o.s >= t.e) o WHERE r = 1)
          SELECT request_id, CAST(i AS INTEGER) AS literal, substring(text, s, e - s) AS text, octet_length(encode(left(text, s - 1))) AS match_offset, octet_length(encode(substring(text, s, e - s))) AS match_length FROM taken""",
        "session_created": f"""WITH {TURNS_SQL}, {STORE_SQL},
          a0 AS (SELECT x.session_id AS session_id, x.source AS source, x.ts AS ts FROM requests WHERE x.ts IS NOT NULL),
          asked AS (SELECT 'new-' || source AS session_id, min(ts) AS asked_at FROM a0 WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT session_id, max(ts) FROM a0 WHERE session_id IS NOT NULL GROUP BY session_id),
          live AS (SELECT *, sum(CASE WHEN starts_with(session_id, 'new-') THEN 1 ELSE 0 END) OVER (ORDER BY asked_at, session_id) AS used, starts_with(session_id, 'new-') AS fresh FROM asked),
          ok AS (SELECT session_id, asked_at FROM live WHERE used < 3 OR used = 3 AND fresh)
          SELECT * FROM store WHERE session_id NOT IN (SELECT session_id FROM ok) UNION ALL SELECT session_id, 0, 0.0, asked_at, 1800 FROM ok""",
        "session_deleted": f"WITH {TURNS_SQL}, {STORE_SQL} SELECT * FROM store WHERE session_id NOT IN (SELECT r.x.session_id FROM requests r JOIN scan_responses p USING (request_id) WHERE p.decision = 'block' AND r.x.session_id IS NOT NULL)",
        "session_cleaned": f"WITH {TURNS_SQL}, {STORE_SQL} SELECT session_id, turn_count, CASE WHEN epoch_us((SELECT max(last_accessed) + INTERVAL 1 HOUR FROM store)) - epoch_us(last_accessed) >= ttl * 1000000 THEN 'removed' ELSE 'kept' END AS what FROM store",
        "signature_layers": "SELECT signature_id, category, CASE WHEN severity = 'critical' THEN anomaly_points + 1 ELSE anomaly_points END AS anomaly_points FROM signatures UNION ALL SELECT 'NEW-001', 'agentic', 5",
        "semantic_neighbours": f"WITH {PHRASES_SQL} SELECT vec_id, rank, phrase_id, round(sim, 5) AS similarity FROM ranked",
        "semantic_best": f"WITH {PHRASES_SQL} SELECT vec_id, label, round(max(sim), 5) AS similarity FROM ranked WHERE sim > 0 GROUP BY vec_id, label",
        "semantic_hits": f"WITH {PHRASES_SQL} SELECT vec_id, label AS signature_id, format('semantic similarity={{:.3f}}', max(sim)) AS matched_text FROM ranked WHERE sim > 0 GROUP BY vec_id, label HAVING max(sim) >= CASE label WHEN '0' THEN 0.55 WHEN '1' THEN 0.60 ELSE 0.75 END",
        "session_states": f"WITH {TURNS_SQL} SELECT session_id, life, max(turn) AS turn_count, round(sum(coalesce(score, 0.0)), 6) AS cumulative_score, max(ts) AS last_accessed FROM turns GROUP BY session_id, life",
        "session_running": f"WITH {TURNS_SQL} SELECT session_id, request_id, life, turn, round(sum(coalesce(score, 0.0)) OVER (PARTITION BY session_id, life ORDER BY turn ROWS UNBOUNDED PRECEDING), 6) AS cumulative_score FROM turns",
        "session_history": f"WITH {TURNS_SQL}, {MATCHES_SQL}, s AS (SELECT t.session_id, t.life, list(m.signature_id ORDER BY t.turn, m.match_no, m.match_id) FILTER (WHERE m.signature_id IS NOT NULL) AS l FROM turns t LEFT JOIN matches m USING (request_id) GROUP BY t.session_id, t.life) SELECT session_id, life, least(coalesce(len(l), 0), 500) AS kept, coalesce(array_to_string(l[greatest(len(l) - 499, 1):], ','), '') AS signatures FROM s",
        "guarded_calls": f"WITH {REQUESTS_SQL}, d AS (SELECT r.x.session_id AS session_id, r.x.direction AS direction, p.decision, row_number() OVER (PARTITION BY r.x.session_id, r.x.direction ORDER BY r.x.ts, r.request_id) AS call FROM requests r JOIN scan_responses p USING (request_id) WHERE r.x.session_id IS NOT NULL) SELECT a.session_id, a.call, a.decision AS input_decision, CASE WHEN a.decision <> 'block' THEN b.decision END AS output_decision, CASE WHEN a.decision = 'block' OR b.decision = 'block' THEN 'block' WHEN a.decision = 'flag' OR b.decision = 'flag' THEN 'flag' ELSE 'allow' END AS decision FROM d a LEFT JOIN d b ON a.session_id = b.session_id AND a.call = b.call AND b.direction = 'output' WHERE a.direction = 'input'",
        "hits_rollup": f"WITH {MATCHES_SQL} SELECT s.category, m.signature_id, count(*) AS hits, count(DISTINCT m.request_id) AS requests FROM matches m JOIN signatures s USING (signature_id) GROUP BY ROLLUP (s.category, m.signature_id)",
        "top_signatures": f"WITH {MATCHES_SQL} SELECT signature_id, count(*) AS hits, round(sum(score), 4) AS score FROM matches GROUP BY signature_id ORDER BY hits DESC, signature_id LIMIT 20",
        "decision_rates": f"WITH {REQUESTS_SQL} SELECT r.x.source AS source, r.x.direction AS direction, count(*) AS requests, count(*) FILTER (WHERE decision = 'block') AS blocked, count(*) FILTER (WHERE decision = 'flag') AS flagged, round(count(*) FILTER (WHERE decision = 'block') / count(*), 6) AS block_rate FROM requests r JOIN scan_responses USING (request_id) GROUP BY 1, 2",
        "audit_counts": "SELECT category, count(DISTINCT audit_id) AS events FROM audit_log GROUP BY category",
        "audit_last": "SELECT audit_id, any_value(audit_action) AS audit_action, any_value(event_ts) AS event_ts FROM audit_log WHERE category = 'scan' GROUP BY audit_id ORDER BY event_ts DESC NULLS LAST, audit_id DESC LIMIT 100",
        "p2_gap_settings": " UNION ALL ".join(
            f"SELECT {g}::BIGINT AS gap_s, count(*) AS sessions, max(d) / 1000000.0 AS longest_s FROM (WITH {EVENTS_SQL.replace('1800000000', str(g * 1000000))} "
            "SELECT epoch_us(max(hi)) - epoch_us(min(lo)) AS d FROM bounds GROUP BY actor, s)"
            for g in sessionize.SETTINGS
        ),
        "p2_found": f"WITH {EVENTS_SQL} SELECT actor, min(audit_id) FILTER (WHERE ts = lo) AS first_audit_id, max(audit_id) FILTER (WHERE ts = hi) AS last_audit_id FROM bounds GROUP BY actor, s",
        "p2_sessions": f"""WITH {EVENTS_SQL} SELECT actor, min(audit_id) FILTER (WHERE ts = lo) AS first_id, max(audit_id) FILTER (WHERE ts = hi) AS last_id, min(lo) AS start, max(hi) AS "end",
          (epoch_us(max(hi)) - epoch_us(min(lo))) / 1000000.0 AS duration, count(*) AS events FROM bounds GROUP BY actor, s""",
    }
