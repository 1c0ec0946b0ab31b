"""Spans aren't shuffled, nothing that grows is broadcast, and Python holds few rows at a time."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions.slices import ROWS, by_slices
from lodestone.operators import overlap, pool, relations


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, " ".join(f"w{k}" for k in range(40))) for i in range(1, 4)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["overlap_allow", "overlap_longest", "overlap_flat", "overlap_greedy", "overlap_nested", "pool_topk", "pool_candidates", "pool_quota", "rel_pairs_topk", "rel_threshold", "ner_abstain"])
def test_only_texts_are_shuffled(spark, folder, name):
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Broadcast" not in plan and "ENSURE_REQUIREMENTS" not in plan


@pytest.mark.parametrize("name", ["rel_canonical", "rel_exact_dedup", "rel_deduplicated", "rec_gated_values", "rec_choice_values", "rec_formatted", "engine_edges", "engine_entities", "engine_fields", "rel_query_sets", "shared_candidates", "struct_instances", "engine_extract"])
def test_nothing_is_broadcast(spark, folder, name):
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_slices(spark):
    kept = by_slices("int", lambda x: pa.array([len(x)] * len(x), pa.int32()))
    got = [r[0] for r in spark.range(0, 1000, 1, 1).select(kept(F.col("id"))).collect()]
    assert len(got) == 1000 and max(got) == ROWS


@pytest.mark.parametrize("policy", ["allow", "longest", "greedy", "nested", "flat"])
def test_folds_of_arrays(policy):
    rng = random.Random(policy)
    groups = [None if g % 7 == 0 else [(rng.choice([0.25, 0.5, 1.0]), s, s + rng.randint(1, 5)) for s in (rng.randint(0, 12) for _ in range(rng.randint(0, 12)))] for g in range(60)]
    kind = pa.list_(pa.struct([("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = pa.array([g and [dict(zip(("confidence", "start", "end"), x)) for x in g] for g in groups], kind)
    for part in (rows, rows.slice(11, 30)):
        got = overlap.fold_arrays(part, policy).to_pylist()
        assert [sorted(tuple(x.values()) for x in g) for g in got] == [sorted(overlap.resolve_list([tuple(x.values()) for x in g or []], policy)) for g in part.to_pylist()]


def test_order_ranks_equal_spans(spark):
    rows = spark.createDataFrame([(1, 0.5, 0, 2, 9, "b"), (1, 0.5, 0, 2, 3, "a"), (1, 0.4, 1, 3, 0, "c")], "doc_id long, confidence double, start int, end int, slot int, surface string")
    for policy in ("greedy", "flat", "nested"):
        got = overlap.resolve(rows, policy, ["doc_id"], [F.col("slot")])
        assert got.columns == rows.columns and [tuple(r) for r in got.collect()] == [(1, 0.5, 0, 2, 3, "a")]


@pytest.mark.parametrize("few", [False, True])
def test_arguments_by_brute_force(spark, few):
    rng = random.Random(3)
    rows = [(d, "r", side, s, s + w, rng.choice([-4.0, -1.0, 0.0, 1.0, 2.5]), rng.randint(0, 2)) for d, n in ((1, 60), (2, 5), (3, 1)) for side in ("head", "tail") for s in range(n) for w in (1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, relation string, side string, start int, end int, logit double, seq int")
    got = sorted((r["doc_id"], r["side"], r["rank"], r["start"], r["end"]) for r in relations.arguments(frame, 7, 4, 0.2, few).collect())
    want = []
    for d in (1, 2, 3):
        for side, cap in (("head", 7), ("tail", 4)):
            best = sorted((-x[5], x[3], x[4], x[6]) for x in rows if x[0] == d and x[2] == side and x[5] > -1.38)[:cap]
            want += [(d, side, i, x[1], x[2]) for i, x in enumerate(best, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["shared_candidates", "rel_query_sets"])
def test_candidates_are_places_alone(spark, folder, name):
    plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "substring" not in plan and plan.count("explode(sequence") <= 4


@pytest.mark.parametrize("low", [-4.0, -20_000.0])
def test_pool_by_brute_force(spark, low):
    rng = random.Random(5)
    config = pool.PoolConfig(4, 7, 2)
    rows = [(d, q, p, rng.randint(0, 6) + low, rng.randint(0, 6) + low, rng.random() < 0.8, q < 2 or d % 2 == 0) for d in range(9) for q in range(3) for p in range(d)]
    frame = spark.createDataFrame(rows, "doc_id long, query_id int, pos int, start_logit double, end_logit double, mask boolean, query_mask boolean")
    got = {(r["doc_id"], r["slot"]): (r["start"], r["end"], r["proposal"]) for r in pool.candidate_pool(frame, config, lambda _, s, e: s * 0.25 - e * 0.5).collect()}
    want = {}
    for d in range(9):
        own = {(r[1], r[2]): r for r in rows if r[0] == d}
        worth = {p: [max(r[i] if r[5] and r[6] else -10_000.0 for (_, at), r in own.items() if at == p) for i in (3, 4)] + [any(r[5] and r[6] for (_, at), r in own.items() if at == p)] for _, p in own}
        best = [[(p if worth[p][2] else 0, worth[p][2], worth[p][i], p) for p in sorted(worth, key=lambda p: (-worth[p][i], p))[:4]] for i in (0, 1)]
        pairs = [(s[0], e[0], s[1] and e[1] and e[0] > s[0], s[0] * 0.25 - e[0] * 0.5, s[2], e[2], s[3], e[3]) for s in best[0] for e in best[1]]
        every = [(s, e, live, c + a + b, c + a + b) for s, e, live, c, a, b, _, _ in pairs]
        for q in range(3):
            of = sorted((-(own[q, x[6]][3] + own[q, x[7]][4] + x[3]), i) for i, x in enumerate(pairs) if x[2] and own[q, x[6]][6])[:2]
            every += [(*pairs[i][:2], True, 5002.0 - r, pairs[i][3] + pairs[i][4] + pairs[i][5]) for r, (_, i) in enumerate(of)]
        first = {}
        for i in sorted(range(len(every)), key=lambda i: -every[i][3]):
            if every[i][2]:
                first.setdefault(every[i][:2], i)
        ranked = sorted((-(x[3] if first.get(x[:2]) == i else -10_000.0), x[0], x[1], first.get(x[:2]) != i, x[4]) for i, x in enumerate(every))
        want |= {(d, slot): (s, e, p) for slot, (_, s, e, gone, p) in enumerate(ranked[:7]) if not gone}
    assert got == want and len(want) > 20
