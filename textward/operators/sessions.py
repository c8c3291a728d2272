"""Sessions of conversations: risk accumulated over turns, with limits and a time-out.

A turn that comes ``ttl`` or later after the session's previous one starts the session afresh.
Turns beyond MAX_TURNS of a session's life change nothing; the newest MAX_HISTORY signature ids are kept.
A store of sessions is a table of states, one row per session; create, delete, get, clean-up and
count work on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.operators.timeline import micros, places

# Fixed values.
MAX_TURNS = 200
MAX_HISTORY = 500
MAX_SESSIONS = 100_000
TTL = 1800


def turns(df: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "request_id", ttl: int = TTL) -> DataFrame:
    """Add ``life`` (0, 1, ...) and ``turn`` (1, ...) within it; rows without session or time are left out."""
    return places(df, [session], ts, tie, ttl).drop("rank")


def fold(
    df: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "request_id", score: str = "score", signatures: str | None = "signatures", ttl: int = TTL
) -> DataFrame:
    """session, life, turn_count, cumulative_score, last_accessed[, matched_signatures]: the state at the end of each life.

    Refused turns (beyond MAX_TURNS) don't count, so a state gathers at most MAX_TURNS rows. Null
    scores count as 0, null signature lists as empty.
    """
    kept = turns(df, session, ts, tie, ttl).where(F.col("turn") <= MAX_TURNS)
    aggs = [F.max("turn").alias("turn_count"), F.sum(F.coalesce(F.col(score), F.lit(0.0))).alias("cumulative_score"), F.max(ts).alias("last_accessed")]
    if signatures:
        each = F.struct("turn", F.coalesce(F.col(signatures), F.array().cast("array<string>")).alias("s"))
        listed = F.flatten(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["s"]))
        aggs.append(F.slice(listed, F.greatest(F.size(listed) - (MAX_HISTORY - 1), F.lit(1)), MAX_HISTORY).alias("matched_signatures"))
    return kept.groupBy(session, "life").agg(*aggs)


def running(df: DataFrame, session: str = "session_id", ts: str = "ts", tie: str = "request_id", score: str = "score", ttl: int = TTL) -> DataFrame:
    """session, tie, life, turn, cumulative_score after each accepted turn."""
    kept = turns(df, session, ts, tie, ttl).where(F.col("turn") <= MAX_TURNS)
    # a life has at most MAX_TURNS rows
    total = F.sum(F.coalesce(F.col(score), F.lit(0.0))).over(Window.partitionBy(session, "life").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return kept.select(session, tie, "life", "turn", total.alias("cumulative_score"))


def create(states: DataFrame, asked: DataFrame, session: str = "session_id", limit: int = MAX_SESSIONS) -> DataFrame:
    """The store after sessions are asked for, in the order of ``at`` (then by name): (session, at[, ttl]).

    A session that is there already starts afresh. While the store holds ``limit`` sessions or more
    every request is refused, also for one that is there. A null ttl is TTL; null names are left
    out; of several requests for one session the last accepted one counts.
    """
    room = max(0, limit - count(states))
    rows = asked.where(F.col(session).isNotNull())
    rows = rows.select(session, micros("at").alias("_at"), (F.col("ttl") if "ttl" in asked.columns else F.lit(None)).cast("int").alias("_ttl"))
    known = states.select(session, F.lit(1).alias("_known")).distinct()
    # requests for new names fill the room, the later ones are refused; once it is full so are all others
    first = rows.join(known, session, "left_anti").groupBy(session).agg(F.min("_at").alias("_at"))
    filled = first.orderBy("_at", session).limit(room)
    edge = filled.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_at", session)).alias("last")).first()
    if room == 0:
        accepted = rows.limit(0)
    elif edge.n < room:
        accepted = rows
    else:
        accepted = rows.where(F.struct("_at", session) <= F.struct(F.lit(edge.last[0]), F.lit(edge.last[1])))
    last = accepted.groupBy(session).agg(F.max_by(F.struct("_at", "_ttl"), F.col("_at")).alias("x"))
    fresh = last.select(
        session,
        F.lit(0).cast("long").alias("turn_count"),
        F.lit(0.0).alias("cumulative_score"),
        F.timestamp_micros("x._at").cast(states.schema["last_accessed"].dataType).alias("last_accessed"),
        F.coalesce("x._ttl", F.lit(TTL)).alias("ttl"),
    )
    return states.join(fresh.select(session), session, "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete(states: DataFrame, names: DataFrame, session: str = "session_id") -> DataFrame:
    """The store without the named sessions; unknown names change nothing."""
    return states.join(names.select(session).distinct(), session, "left_anti")


def get(states: DataFrame, names: DataFrame, session: str = "session_id") -> DataFrame:
    """Every name asked for, once, with its state (null where there is no such session)."""
    return names.select(session).distinct().join(states, session, "left")


def count(states: DataFrame) -> int:
    """How many sessions a store holds."""
    return states.count()


def is_expired(now: Column, last: str = "last_accessed", ttl: Column | int = TTL) -> Column:
    """Whether a session was not used for its ttl (seconds) at ``now``."""
    return micros(now) - micros(last) >= (ttl if isinstance(ttl, Column) else F.lit(ttl)).cast("long") * 1_000_000


def expired(states: DataFrame, now, ttl: int = TTL) -> DataFrame:
    """States not used for their ttl at ``now``: what a clean-up removes. A column ``ttl`` counts per session."""
    own = F.coalesce(F.col("ttl"), F.lit(ttl)) if "ttl" in states.columns else F.lit(ttl)
    return states.where(is_expired(F.lit(now), ttl=own))


def clean(states: DataFrame, now, ttl: int = TTL) -> DataFrame:
    """The store after a clean-up at ``now``; sessions without a last use stay."""
    own = F.coalesce(F.col("ttl"), F.lit(ttl)) if "ttl" in states.columns else F.lit(ttl)
    return states.where(~F.coalesce(is_expired(F.lit(now), ttl=own), F.lit(False)))
