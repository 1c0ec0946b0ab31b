"""What is done with spans that overlap.

First of all spans with equal coordinates only the best stays: by confidence, start, end, place.
Then: allow keeps all; longest drops spans inside a larger one, even if that one goes too; nested
keeps in order of rank what doesn't cross anything kept; greedy keeps in order of rank what
doesn't touch anything kept; flat keeps the disjoint set with the greatest sum of confidences
(of these the one with more spans, then the better ranked).

allow and longest are windows over rows. The others look back at what was kept: each group's spans
are gathered in an array with all of their columns and folded in one pass, some groups at a time.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.slices import by_slices

# Names of the policies and what else they are called.
POLICIES = {"allow": "allow", "all": "allow", "nested": "nested", "allow_nested": "nested", "longest": "longest", "keep_longest": "longest", "flat": "flat", "none": "flat", "disallow": "flat", "no_overlap": "flat", "non_overlapping": "flat", "greedy": "greedy"}

Span = tuple[float, int, int]


def policy_of(name: str) -> str:
    key = name.strip().lower().replace("-", "_")
    if key not in POLICIES:
        raise ValueError(f"overlap policy {name!r}")
    return POLICIES[key]


def distinct_coordinates(spans: DataFrame, group: list[str], order: list | None = None) -> DataFrame:
    """The best of spans with equal coordinates. order: what ranks them after confidence, such as their place."""
    over = Window.partitionBy(*group, "start", "end").orderBy(F.desc("confidence"), *(order or []))
    return spans.withColumn("_r", F.row_number().over(over)).filter("_r = 1").drop("_r")


def longest(spans: DataFrame, group: list[str], order: list | None = None) -> DataFrame:
    """Drops spans inside one before them, which begins no later and ends no earlier: a larger one, or a better one with equal coordinates."""
    before = Window.partitionBy(*group).orderBy("start", F.desc("end"), F.desc("confidence"), *(order or [])).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_e", F.max("end").over(before)).filter("_e IS NULL OR _e < end").drop("_e")


def resolve(spans: DataFrame, policy: str, group: list[str], order: list | None = None) -> DataFrame:
    """Spans that the policy keeps, with all of their columns. group: what separates texts and queries."""
    policy = policy_of(policy)
    if policy == "allow":
        return distinct_coordinates(spans, group, order)
    if policy == "longest":
        return longest(spans, group, order)
    rank = {f"_o{i}": c for i, c in enumerate(order or [])}
    judged = F.struct("confidence", "start", "end", *(c.alias(n) for n, c in rank.items()))
    rest = [c for c in spans.columns if c not in (*group, "confidence", "start", "end")]
    gathered = spans.groupBy(*group).agg(F.collect_list(judged).alias("_s"), F.collect_list(F.struct(F.lit(0).alias("_"), *rest)).alias("_x"))
    kept = gathered.select(*group, "_s", "_x", F.explode(folded(policy)("_s")).alias("_k"))
    column = lambda c: F.col(c) if c in group else F.get("_x" if c in rest else "_s", F.col("_k"))[c].alias(c)
    return kept.select(*map(column, spans.columns))


def kept_places(groups: pa.Array, policy: str) -> pa.Array:
    """For each array of (confidence, start, end, and what ranks spans after these) the places of those that stay, best first."""
    counts = pc.fill_null(pc.list_value_length(groups), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = groups.flatten()
    column = lambda i: pc.struct_field(flat, [i]).to_numpy(zero_copy_only=False)
    confidence, start, end, *rank = (column(i) for i in range(flat.type.num_fields))
    group = np.repeat(np.arange(len(groups)), counts)
    order = np.lexsort((*reversed(rank), end, start, -confidence, group))
    # Of equal coordinates the first in order.
    same = np.lexsort((end[order], start[order], group[order]))
    g, s, e = (x[order][same] for x in (group, start, end))
    first = np.ones(len(order), bool)
    first[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    keep = np.zeros(len(order), bool)
    keep[same[first]] = True
    order = order[keep]
    own, begins = group[order], np.cumsum(counts) - counts
    places = order - begins[own]
    if policy != "allow":
        cuts = np.searchsorted(own, np.arange(len(groups) + 1))
        parts = [stay(confidence[order[a:b]].tolist(), start[order[a:b]].tolist(), end[order[a:b]].tolist(), policy) for a, b in zip(cuts[:-1], cuts[1:])]
        chosen = np.concatenate([a + np.array(p, np.int64) for a, p in zip(cuts[:-1], parts)]) if parts else np.zeros(0, np.int64)
        places, own = places[chosen], own[chosen]
    ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(groups)))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places.astype(np.int32)))


def fold_arrays(groups: pa.Array, policy: str) -> pa.Array:
    """For each array of (confidence, start, end) those that stay, best first."""
    places = kept_places(groups, policy)
    counts = pc.fill_null(pc.list_value_length(groups), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = np.diff(places.offsets.to_numpy())
    at = places.values.to_numpy() + np.repeat(np.cumsum(counts) - counts, kept)
    return pa.ListArray.from_arrays(places.offsets, groups.flatten().take(pa.array(at)))


def folded(policy: str):
    """Places of the spans that stay, as a function of a column of arrays."""
    return by_slices("array<int>", lambda groups: kept_places(groups, policy))


def ranked(spans: list[Span]) -> list[Span]:
    """Best first, one for each pair of coordinates."""
    seen, out = set(), []
    for c, s, e in sorted(spans, key=lambda x: (-x[0], x[1], x[2])):
        if (s, e) not in seen:
            seen.add((s, e))
            out.append((c, s, e))
    return out


def resolve_list(spans: list[Span], policy: str) -> list[Span]:
    """The policies over one list of (confidence, start, end)."""
    distinct = ranked(spans)
    return [distinct[i] for i in stay(*(list(x) for x in zip(*distinct)), policy_of(policy))] if distinct else []


def stay(confidences: list[float], starts: list[int], ends: list[int], policy: str) -> list[int]:
    """Places of the spans that stay, of one group's in order of rank with distinct coordinates."""
    every = range(len(starts))
    if policy == "allow":
        return list(every)
    if policy == "longest":
        inside, end = set(), None
        for i in sorted(every, key=lambda i: (starts[i], -ends[i])):
            if end is not None and ends[i] <= end:
                inside.add(i)
            end = ends[i] if end is None else max(end, ends[i])
        return [i for i in every if i not in inside]
    if policy == "flat":
        return best_disjoint(list(zip(confidences, starts, ends)))
    kept: list[int] = []
    if policy == "greedy":
        begun, done = [], []  # of what is kept, in order; as they are disjoint both rise
        for i, s, e in zip(every, starts, ends):
            at = bisect_left(begun, e)
            if at and done[at - 1] > s:
                continue
            kept.append(i)
            begun.insert(at, s)
            done.insert(at, e)
        return kept
    places: list[tuple[int, int]] = []  # of what is kept, in order; none is wider than widest
    widest = 0
    for i, s, e in zip(every, starts, ends):
        near = places[bisect_left(places, (s - widest + 1, 0)) : bisect_left(places, (e, 0))]
        if not any(a < e and s < b and not ((a <= s and e <= b) or (s <= a and b <= e)) for a, b in near):
            kept.append(i)
            insort(places, (s, e))
            widest = max(widest, e - s)
    return kept


def best_disjoint(distinct: list[Span]) -> list[int]:
    """Weighted interval scheduling over spans in order of rank: the places of the chosen ones."""
    rank = {x: i for i, x in enumerate(distinct)}
    by_end = sorted(distinct, key=lambda x: (x[2], x[1]))
    ends = [x[2] for x in by_end]
    # For each number of spans considered: sum, count, and the chosen ones as a chain.
    best: list[tuple[float, int, tuple | None]] = [(0.0, 0, None)]

    def chosen(chain) -> list[int]:
        out = []
        while chain:
            out.append(rank[chain[0]])
            chain = chain[1]
        return sorted(out)

    for i, x in enumerate(by_end):
        total, count, chain = best[bisect_right(ends, x[1], 0, i)]
        taken, left = (total + x[0], count + 1, (x, chain)), best[i]
        if taken[:2] != left[:2]:
            best.append(max(taken, left, key=lambda t: t[:2]))
        else:
            best.append(taken if chosen(taken[2]) < chosen(left[2]) else left)
    return chosen(best[-1][2])
