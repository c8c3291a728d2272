"""Sessions from a Cartesian tree over the gaps between consecutive events of an entity.

The gaps of an entity's timeline form a Cartesian tree: the largest gap is the root and splits
the timeline in two. Every node knows its span (start, end, events) and its height, the largest
gap inside; equal gaps are one node with several children. Cutting at a threshold t gives the nodes
with height < t <= height of the parent: the sessions. The tree is built once and serves any
threshold by a filter.

Gaps count in whole seconds (a gap reaches a threshold of whole seconds if its whole seconds do).
So a rising or falling chain of n different gaps lasts n * n / 2 seconds or more, which bounds the
chains of a timeline by its duration, whatever the number of its events.

Timelines of any length are built in chunks. A gap is open in its chunk if it is a maximum of all
gaps before it or of all after it; between open gaps lie complete subtrees, which go on as single
items. Between two equal open gaps an item is complete too: it is written, and its events become a
bridge between its neighbours. Items of an entity meet in the next round, until those of each fit
into one chunk; the last round joins them. No task holds more than a chunk, or an entity's chains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.session import materialise

#: Microseconds.
SECOND = 1_000_000
#: ``gap`` and ``bridge`` of an item are null and 0 unless events lie between it and the item before it.
FIELDS = ("start", "end", "n", "first_id", "last_id", "height", "gap", "bridge")
SHOWN = FIELDS[:6]
NODE = "actor string, start long, end long, n long, first_id long, last_id long, height long, gap long, bridge long, parent long, open boolean"
INFINITE = 2**62
#: A last round takes at most so many items of an entity, unless a round no longer shrinks them.
REST = 50_000
_HEIGHT, _GAP, _BRIDGE = 5, 6, 7


def build(items: list[tuple], left: bool, right: bool) -> tuple[list[tuple], list[tuple]]:
    """(nodes, items still open) of consecutive items (FIELDS).

    ``left`` and ``right`` tell whether the timeline goes on beyond the items. Nodes carry the
    height of their parent last. Without more on either side all nodes are complete, and the
    root's parent is INFINITE.
    """
    gaps = [(b[0] - a[1]) // SECOND if b[_BRIDGE] == 0 else b[_GAP] for a, b in zip(items, items[1:])]
    n = len(gaps)
    opened = [False] * n
    if left:
        top = -1
        for i, g in enumerate(gaps):
            if g >= top:
                opened[i], top = True, g
    if right:
        top = -1
        for i in range(n - 1, -1, -1):
            if gaps[i] >= top:
                opened[i], top = True, gaps[i]
    nodes: list[tuple] = []
    out: list[tuple] = []
    between: list[int] = []
    at = 0
    for i in range(n + 1):
        if i == n or opened[i]:
            out.append(_subtree(items[at : i + 1], gaps[at:i], nodes))
            if i < n:
                between.append(gaps[i])
            at = i + 1
    if not left and not right:
        nodes.append((*out[0], INFINITE))
        return nodes, []
    return nodes, _folded(out, between, nodes)


def _folded(items: list[tuple], gaps: list[int], nodes: list[tuple]) -> list[tuple]:
    """Open items without those between two equal gaps, which are complete and become bridges."""
    out, bridge = [items[0]], 0
    for i in range(1, len(items)):
        item = items[i]
        if i < len(gaps) and gaps[i - 1] == gaps[i]:
            nodes.append((*item, gaps[i]))
            bridge += item[_BRIDGE] + item[2]
            continue
        bridge += item[_BRIDGE]
        out.append((*item[:_GAP], gaps[i - 1] if bridge else -1, bridge))
        bridge = 0
    return out


def _join(children: list[tuple], gap: int) -> tuple:
    """The node over children next to one another, parted by equal gaps."""
    first, last = children[0], children[-1]
    low = min(c[3] for c in children if c[0] == first[0])
    # ids at equal times: the smallest of the earliest, the largest of the latest time
    high = max(c[4] for c in children if c[1] == last[1])
    events = sum(c[2] for c in children) + sum(c[_BRIDGE] for c in children[1:])
    return (first[0], last[1], events, low, high, gap, first[_GAP], first[_BRIDGE])


def _subtree(items: list[tuple], gaps: list[int], nodes: list[tuple]) -> tuple:
    """Root of the tree over items; all other nodes are appended with their parent's height."""
    # stack of (children so far, gap that parts them), gaps falling from bottom to top
    stack: list[tuple[list[tuple], int]] = []
    current = items[0]
    for gap, item in zip(gaps, items[1:]):
        while stack and stack[-1][1] < gap:
            children, g = stack.pop()
            children.append(current)
            nodes.extend((*c, g) for c in children)
            current = _join(children, g)
        if stack and stack[-1][1] == gap:
            stack[-1][0].append(current)
        else:
            stack.append(([current], gap))
        current = item
    while stack:
        children, g = stack.pop()
        children.append(current)
        nodes.extend((*c, g) for c in children)
        current = _join(children, g)
    return current


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes and open items of each Arrow batch of a sorted partition."""
    for frame in frames:
        if not len(frame):
            continue
        actors = frame["actor"].to_numpy()
        edges = np.flatnonzero(actors[1:] != actors[:-1]) + 1
        bounds = [0, *edges.tolist(), len(actors)]
        rows = list(zip(*(frame[c].tolist() for c in FIELDS)))
        out: list[tuple] = []
        last = len(bounds) - 2
        for k in range(last + 1):
            a, b = bounds[k], bounds[k + 1]
            # an actor may go on beyond the batch only at its ends
            nodes, rest = build(rows[a:b], k == 0, k == last)
            out += [(actors[a], *x, False) for x in nodes]
            out += [(actors[a], *x, INFINITE, True) for x in rest]
        yield pd.DataFrame(out, columns=["actor", *FIELDS, "parent", "open"])


def _rest(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["start", "end", "first_id"], kind="stable")
    nodes, _ = build(list(zip(*(frame[c].tolist() for c in FIELDS))), False, False)
    return pd.DataFrame([(key[0], *x, False) for x in nodes], columns=["actor", *FIELDS, "parent", "open"])


def gap_tree(events: DataFrame, rest: int = REST) -> DataFrame:
    """actor, start, end, n, first_id, last_id, height, parent of all nodes, from actor, ts, id.

    Times are microseconds, heights whole seconds; leaves are events (height -1), the root of an actor
    has an INFINITE parent. Rows with a null actor or time are left out; equal times are parted by
    gaps of 0, and repeated rows count as often as they occur. Further columns are ignored; an empty
    table gives an empty result. Rounds of chunks go on until no actor has more than ``rest`` open
    items, or until a round leaves more than half of them.
    """
    rows = events.where("actor IS NOT NULL AND ts IS NOT NULL").select(
        "actor", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"), F.col("id").cast("long").alias("first_id")
    )
    items = rows.select(
        "actor", "start", F.col("start").alias("end"), F.lit(1).cast("long").alias("n"), "first_id", F.col("first_id").alias("last_id"),
        *[F.lit(v).cast("long").alias(c) for c, v in (("height", -1), ("gap", -1), ("bridge", 0))],
    )
    done, before = [], None
    while True:
        spread = items.repartitionByRange("actor", "start", "first_id").sortWithinPartitions("actor", "start", "end", "first_id")
        parts = materialise(spread.select("actor", *FIELDS).mapInPandas(_chunks, NODE), "gaps")
        done.append(parts.where("NOT open"))
        items = parts.where("open").select("actor", *FIELDS)
        most = items.groupBy("actor").count().agg(F.max("count")).first()[0] or 0
        if most <= rest or before is not None and most > before / 2:
            break
        before = most
    done.append(items.groupBy("actor").applyInPandas(_rest, NODE))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("actor", *SHOWN, "parent")


def cut(tree: DataFrame, seconds: int) -> DataFrame:
    """Sessions of a tree: no inner gap of ``seconds`` (whole) or more; actor, first_id, last_id, start, end, duration, events."""
    limit = int(seconds)
    if limit != seconds:
        raise ValueError("a threshold counts whole seconds")
    rows = tree.where((F.col("height") < limit) & (F.col("parent") >= limit))
    return rows.select(
        "actor",
        "first_id",
        "last_id",
        F.timestamp_micros("start").alias("start"),
        F.timestamp_micros("end").alias("end"),
        ((F.col("end") - F.col("start")) / SECOND).alias("duration"),
        F.col("n").alias("events"),
    )
