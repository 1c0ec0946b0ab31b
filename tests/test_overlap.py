import itertools
import random

import pytest

from lodestone.operators.overlap import policy_of, ranked, resolve, resolve_list

# Spans are (confidence, start, end).
CASES = [
    ("flat", [(0.9, 0, 4), (0.6, 0, 2), (0.6, 2, 4)], [(0.6, 0, 2), (0.6, 2, 4)]),
    ("allow", [(0.95, 0, 6), (0.9, 1, 3), (0.85, 2, 5), (0.8, 6, 8)], [(0.95, 0, 6), (0.9, 1, 3), (0.85, 2, 5), (0.8, 6, 8)]),
    ("nested", [(0.95, 0, 6), (0.9, 1, 3), (0.85, 2, 5), (0.8, 6, 8)], [(0.95, 0, 6), (0.9, 1, 3), (0.8, 6, 8)]),
    ("longest", [(0.95, 0, 6), (0.9, 1, 3), (0.85, 2, 5), (0.8, 6, 8)], [(0.95, 0, 6), (0.8, 6, 8)]),
    ("no-overlap", [(1.0, 0, 4), (0.5, 0, 2), (0.5, 2, 4)], [(0.5, 0, 2), (0.5, 2, 4)]),
    ("non_overlapping", [(0.5, 0, 2), (0.5, 2, 4), (0.5, 0, 1), (0.5, 1, 4)], [(0.5, 0, 1), (0.5, 1, 4)]),
    ("all", [(0.4, 0, 2), (0.8, 0, 2), (0.7, 2, 4), (0.7, 4, 6)], [(0.8, 0, 2), (0.7, 2, 4), (0.7, 4, 6)]),
    ("longest", [(0.9, 0, 3), (0.8, 0, 4), (0.7, 0, 5)], [(0.7, 0, 5)]),
    ("greedy", [], []),
]


@pytest.mark.parametrize("policy, spans, want", CASES)
def test_cases(policy, spans, want):
    assert resolve_list(spans, policy) == want


def brute(spans, policy):
    spans = ranked(spans)
    touch = lambda a, b: a[1] < b[2] and b[1] < a[2]
    inside = lambda a, b: b[1] <= a[1] and a[2] <= b[2]
    if policy == "longest":
        return [a for a in spans if not any(a is not b and inside(a, b) for b in spans)]
    if policy == "flat":
        best = None
        for k in range(len(spans) + 1):
            for c in itertools.combinations(range(len(spans)), k):
                if not any(touch(spans[a], spans[b]) for a, b in itertools.combinations(c, 2)):
                    key = (-sum(spans[i][0] for i in c), -k, c)
                    best = key if best is None or key < best else best
        return [spans[i] for i in best[2]]
    kept = []
    for a in spans:
        clash = [b for b in kept if touch(a, b)]
        if policy == "nested":
            clash = [b for b in clash if not inside(a, b) and not inside(b, a)]
        if not clash:
            kept.append(a)
    return kept


def random_spans(rng, n):
    return [(rng.choice([0.25, 0.5, 0.75, 1.0]), s, s + rng.randint(1, 5)) for s in (rng.randint(0, 8) for _ in range(n))]


@pytest.mark.parametrize("policy", ["greedy", "nested", "longest", "flat"])
def test_brute_force(policy):
    rng = random.Random(policy)
    for _ in range(400):
        spans = random_spans(rng, rng.randint(0, 8))
        assert resolve_list(spans, policy) == brute(spans, policy)


@pytest.mark.parametrize("policy", ["allow", "longest", "greedy", "nested", "flat"])
def test_rows_equal_lists(spark, policy):
    rng = random.Random(5)
    groups = {d: ranked(random_spans(rng, 9)) for d in range(30)}
    rows = spark.createDataFrame([(d, c, s, e) for d, g in groups.items() for c, s, e in g], "doc_id long, confidence double, start int, end int")
    got = {d: set() for d in groups}
    for r in resolve(rows, policy, ["doc_id"]).collect():
        got[r["doc_id"]].add((r["confidence"], r["start"], r["end"]))
    assert got == {d: set(resolve_list(g, policy)) for d, g in groups.items()}


def test_names():
    assert policy_of(" Allow-Nested ") == "nested" and policy_of("keep_longest") == "longest"
    with pytest.raises(ValueError):
        policy_of("some")
