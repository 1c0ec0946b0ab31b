"""The shared pool and what is split from it, against definitions on small inputs."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.operators import choices as C
from lodestone.operators import records, relations, spans
from lodestone.operators.pool import PoolConfig
from lodestone.plans import prompts
from lodestone.plans.schema import CompiledField, Field, RecordField, RecordOptions, SchemaBuilder, SchemaError, Validator
from lodestone.providers.base import FAMILIES, ColumnProvider
from lodestone.providers.checked import CHECKS, Checked
from lodestone.providers.hashing import HashingProvider
from lodestone.providers.table import TableProvider
from lodestone.sources.config import PINNED, ModelConfig, read_config
from lodestone.sources.readers import batches
from lodestone.streaming.rowlocal import by_batch, decode

WIDE = ModelConfig(architecture="boundary", overlap_policy="longest", pool_top_k=100, pool_capacity=2000, pool_per_query=50)


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["Ada Lovelace met Charles Babbage in London, x or y. Red or BLUE was asked", "hello world", "", None, "grün y rot x grün und mehr davon heute", "the end of the red line"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_prefix_changes_no_place_in_the_text(docs):
    """The same queries with and without choices before the text: equal spans, relations and offsets."""

    def found(fields):
        schema = SchemaBuilder().structure("event", fields).entities("person", "place").relation("knows").build()
        engine = Engine(HashingProvider(3), WIDE)
        engine.set_overlap_policy("allow")  # else spans that begin in the prefix may hold others back
        rows = engine.extract(docs, schema, 0.6, True, True).collect()
        return {r["doc_id"]: (r["entities"], r["relations"]) for r in rows}, engine

    with_choices, engine = found(["kind::[red|blue]"])
    without, _ = found(["kind::str"])
    assert any(s for e, _ in without.values() for s in e["person"]) and any(r["knows"] for _, r in without.values())

    def text_only(rows, schema_has_prefix):
        return {i: (Counter(map(str, e["person"] + e["place"])), sorted(map(str, r["knows"]))) for i, (e, r) in rows.items()}

    a, b = text_only(with_choices, True), text_only(without, False)
    # Entities' queries have the same numbers in both schemas, so all that is in the text is the same.
    assert {i: x[0] for i, x in a.items()} == {i: x[0] for i, x in b.items()}
    engine.release()
    assert engine._held == []


def test_words_are_split_once_for_all_families(docs):
    schema = SchemaBuilder().structure("event", ["who::str", "kind::[red|blue]"]).entities("person").relation("knows").classification("mood", ["a", "b"]).build()
    with Engine(HashingProvider(3), WIDE) as engine:
        leaves = engine.extract(docs, schema, 0.6)._jdf.queryExecution().withCachedData().collectLeaves()
        assert len(engine._held) == 2 and {leaves.apply(i).nodeName() for i in range(leaves.size())} == {"InMemoryRelation"}


def test_shared_pool_holds_every_query(docs):
    schema = SchemaBuilder().structure("event", ["who::str", "kind::[red|blue]"]).entities("person").relation("knows").build()
    engine = Engine(HashingProvider(3), ModelConfig(architecture="boundary", pool_top_k=4, pool_capacity=9, pool_per_query=2))
    ready = engine.prepared(docs, schema)
    prefix = prompts.choice_prefix(schema.structures[0])
    assert {r["prefix_words"] for r in ready.collect()} == {len(prefix)}
    rows = engine.shared_pool(ready, schema).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"], set()).add((r["slot"], r["start"], r["end"], r["surface"]))
    assert all(len(x) <= 9 for x in by_text.values()) and {r["query_id"] for r in rows} == set(range(5))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        inside = r["start"] >= len(prefix)
        assert (r["surface"] is not None) == inside
        if inside:
            assert texts[r["doc_id"]].encode()[r["byte_start"] : r["byte_end"]].decode().strip() == r["surface"]


# -- choices of records


def brute_choice(text, choices, anchors, record, formatted, scores, scalar, threshold):
    """One record's value: its own nearest or all literals, none if they are others', surfaces, the prefix. anchors: {record: (start, char_start, char_end)}."""
    owner = {}
    held = sorted((a[0], r) for r, a in anchors.items())
    for m in C.literal_mentions(text, list(dict.fromkeys(choices))):
        if held:
            own = [r for start, r in held if start <= m["start"]]
            owner.setdefault(own[-1] if own else held[0][1], []).append(m)
    has = bool(C.literal_mentions(text, choices))
    mine, seen = [], set()
    for m in owner.get(record, []):
        if m["choice"] not in seen:
            seen.add(m["choice"])
            mine.append(m)
    if scalar and mine:
        a = anchors[record]
        mine = [min(mine, key=lambda m: (max(0, a[1] - m["char_end"], m["char_start"] - a[2]), m["start"], m["choice_idx"]))]
    got = C.record_choice(choices, "str" if scalar else "list", scores, [{"text": s[0], "confidence": s[1], "start": s[2], "end": s[3]} for s in formatted], threshold, record in anchors, has, mine)
    return [(x["text"], round(x["confidence"], 9), x.get("start"), x.get("end")) for x in got]


@pytest.mark.parametrize("scalar", [True, False])
def test_record_choices_by_brute_force(spark, scalar):
    rng = random.Random(3)
    choices = ["red", "Blue", "grün", "straße", "red", "STRASSE"]
    texts, anchors, formatted, scores = {}, {}, {}, {}
    for d in range(60):
        words = [rng.choice(["red", "RED", "blue", "grün", "other", "word", "straße", "Ünder", "ored"]) for _ in range(rng.randrange(9))] if rng.random() < 0.8 else ["plain", "text", "here"]
        text = texts[d] = " ".join(words)
        at = [m.span() for m in re.finditer(r"\S+", text)]
        for r in range(rng.randrange(4)):
            if at and rng.random() < 0.7:
                a, b = rng.choice(at)
                anchors.setdefault(d, {})[r] = (len(text[:a].encode()), a, b)
            else:
                anchors.setdefault(d, {})
            formatted[d, r] = [(rng.choice(["Red", "strasse", "GRÜN", "none"]), rng.random(), i, i + 1) for i in range(rng.randrange(3))]
        scores[d] = [(c, round(rng.random(), 3)) for c in dict.fromkeys(choices) if rng.random() < 0.8]
    want = {}
    for d, r in formatted:
        for k, x in enumerate(brute_choice(texts[d], choices, anchors[d], r, formatted[d, r], scores[d], scalar, 0.5)):
            want[d, r, k] = x
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = C.record_choices(
        make(list(formatted), "doc_id long, record int"),
        make([(d, r, *a) for d, own in anchors.items() for r, a in own.items()], "doc_id long, record int, start int, anchor_char_start int, anchor_char_end int"),
        make([(d, r, i + 1, *x) for (d, r), own in formatted.items() for i, x in enumerate(own)], "doc_id long, record int, rank int, surface string, confidence double, byte_start int, byte_end int"),
        make(list(texts.items()), "doc_id long, text string"),
        make([(d, i, c, p) for d, own in scores.items() for i, (c, p) in enumerate(own)], "doc_id long, choice_idx int, choice string, probability double"),
        choices,
        scalar,
        0.5,
    ).collect()
    assert {(r["doc_id"], r["record"], r["rank"]): (r["choice"], round(r["confidence"], 9), r["byte_start"], r["byte_end"]) for r in got} == want and len(want) > 30


def test_engine_records_with_choices(docs):
    schema = SchemaBuilder().structure("s", ["name::str", "color::[red|blue|grün]", Field("note", validators=(Validator("o", "partial"),))]).build()
    options = {"s": RecordOptions("natural", "name", {f: RecordField(exclusive=False) for f in ("name", "color", "note")})}
    rows = Engine(HashingProvider(3), WIDE).extract(docs, schema, 0.2, True, True, options).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    seen = Counter()
    for r in rows:
        for record in (r["structures"] or {}).get("s", []):
            for field, values in json.loads(record).items():
                for v in (json.loads(x)["v"] for x in values):
                    seen[field, "start" in v] += 1
                    if "start" in v:
                        own = texts[r["doc_id"]].encode()[v["start"] : v["end"]].decode()
                        assert own.casefold() == v["text"].casefold() if field == "color" else own == v["text"]
                    assert field != "note" or "o" in v["text"].lower()
                assert field == "note" or len(values) == 1
    assert seen["color", True] and seen["name", True]


# -- span structures


def test_span_structures_by_brute_force(docs):
    structure = SchemaBuilder().structure("event", ["who::str", Field("what", threshold=0.75), "kind::[x|y]", "flag::[a|b|A|ab]::list"]).build()
    provider, threshold = HashingProvider(3), 0.7
    rows = Engine(provider).extract(docs, structure, threshold).collect()
    prefix = prompts.choice_prefix(structure.structures[0])

    def logit(*parts):
        return (sum(p * m for p, m in zip(parts, (7919, 104729, 1299709, 15485863), strict=False)) % 20011 - 10005) / 2000

    def p(x):
        import math

        return 1 / (1 + math.exp(-x))

    from lodestone.functions.text import python_words

    instances_differ = False
    for r in rows:
        text = next(d["text"] for d in docs.collect() if d["doc_id"] == r["doc_id"]) or ""
        words = python_words(text, "span")
        count = max(range(5), key=lambda n: (logit(r["doc_id"], n, 5, 5), -n))
        want = []
        for i in range(count):
            score = lambda s, w, q: p(logit(r["doc_id"], s, w + 16 * i, q))  # noqa: B023, E731

            def spans_of(q, limit):
                found = sorted(((score(s, w, q), s, s + w) for s in range(len(words)) for w in (1, 2, 3) if s + w <= len(words) and score(s, w, q) >= limit), key=lambda x: (-x[0], x[1], x[2]))  # noqa: B023
                kept, out, seen = [], [], set()
                for c, s, e in found:
                    if all(e <= a or b <= s for a, b in kept):
                        kept.append((s, e))
                        surface = text[words[s][1] : words[e - 1][2]]  # noqa: B023
                        if surface.lower() not in seen:
                            seen.add(surface.lower())
                            out.append(surface)
                return out

            held = {}
            if who := spans_of(0, threshold)[:1]:
                held["who"] = who
            if what := spans_of(1, 0.75):
                held["what"] = what
            pairs = [(score(k - len(prefix), 1, 2), c) for c in ("x", "y") for k, t in enumerate(prefix) if c in t.lower()]
            best = max(pairs, key=lambda x: x[0])
            if best[0] >= threshold:
                held["kind"] = [best[1]]
            flags = [c for c in ("a", "b", "ab") if any(c in t.lower() and score(k - len(prefix), 1, 3) >= threshold for k, t in enumerate(prefix))]
            if flags:
                held["flag"] = flags
            if held:
                want.append(held)
        got = [{f: [json.loads(x)["v"] for x in values] for f, values in json.loads(record).items()} for record in r["structures"]["event"]]
        assert got == want, r["doc_id"]
        instances_differ |= len(want) > 1 and want[0] != want[1]
    assert instances_differ


def test_span_entities_need_a_count(spark, docs):
    e = Engine(HashingProvider(3))
    rows = {r["doc_id"]: r["entities"]["person"] for r in e.extract_entities(docs, ["person"], 0.5).collect()}
    counts = {r["doc_id"]: max(range(5), key=lambda n: ((r["doc_id"] * 7919 + n * 104729 + 5 * 1299709 + 8 * 15485863) % 20011, -n)) for r in docs.collect()}
    assert any(rows.values()) and all(not rows[d] for d, n in counts.items() if n == 0)


# -- checks before masks


def test_each_family_checks_its_scores(spark):
    keys = {"task": "string", "relation": "string", "structure": "string", "field": "string"}
    assert set(CHECKS) == set(FAMILIES)
    for family, (columns, names, is_span) in CHECKS.items():
        schema = ", ".join([*(f"{n} {keys.get(n, 'int')}" for n in names), *(f"{c} double" for c in columns), "mask boolean"])
        own = ["k" if n in keys else 7 if n == "doc_id" else 2 if n == "end" else 1 for n in names]

        def asked(scores, mask, own=own, family=family, schema=schema):
            rows = spark.createDataFrame([(*own, *scores, mask)], schema)
            given = type("Given", (TableProvider,), {family: lambda self, *_: rows})()
            return getattr(Checked(given), family)(None).filter("mask").collect()

        fine = [0.5] * len(columns)
        assert len(asked(fine, True)) == 1 and asked(fine, False) == []
        for bad in (float("nan"), float("inf"), None):
            for mask in (True, False):
                with pytest.raises(Exception, match=f"{family}: doc_id 7.*isn't finite"):
                    asked([*fine[:-1], bad], mask)
        if is_span:
            reversed_span = [5 if n == "start" else x for n, x in zip(names, own)]
            with pytest.raises(Exception, match="malformed"):
                asked(fine, True, own=reversed_span)
            assert asked(fine, False, own=reversed_span) == []


# -- relations


def test_query_sets(spark):
    rows = [(1, 0, q, s, s + 1, x) for q in range(3) for s, x in ((0, 2.0), (3, 1.0 + q))]
    shared = spark.createDataFrame(rows, "doc_id long, slot int, query_id int, start int, end int, logit double")
    types = [relations.RelationType("r", (0, 1, 0, 77), (2,)), relations.RelationType("none", (78,), (2,)), relations.RelationType("self", (0,), (0,), True)]
    ends = relations.endpoints(shared, types, 10)
    found = Counter((r["relation"], r["side"]) for r in ends.collect())
    assert found == {("r", "head"): 4, ("r", "tail"): 2, ("none", "tail"): 2, ("self", "head"): 2, ("self", "tail"): 2}
    pairs = relations.propose_pairs(ends, allow_self={"self"}).collect()
    count = Counter(r["relation"] for r in pairs)
    assert count == {"r": 4, "self": 4} and all((r["head_start"], r["head_end"]) != (r["tail_start"], r["tail_end"]) for r in pairs if r["relation"] == "r")
    assert relations.endpoints(shared, [], 10).count() == 0


def test_folded_edges_equal_the_steps(spark):
    rng = random.Random(2)
    names = ["New York City", "New York", "new york", "York", "Albany", "the city", "STRASSE", "straße"]
    rows = []
    for d in range(40):
        for seq in range(1, rng.choice([2, 3, 12, 30])):
            ends = []
            for _ in range(2):
                s = rng.randrange(0, 60, 3)
                e = s + rng.choice([2, 4, 8, 12])
                ends.append((s, e, s, e, names[(s * 7 + e) % len(names)]))
            rows.append((d, "r", *ends, rng.choice([0.5, 0.6, 0.7]), seq))
    kind = "struct<start:int,end:int,char_start:int,char_end:int,text:string>"
    edges = spark.createDataFrame(rows, f"doc_id long, relation string, head {kind}, tail {kind}, score double, seq int")
    done = relations.undominated(relations.semantic_distinct(relations.exact_distinct(relations.canonical_edges(edges))))
    want = Counter((r["doc_id"], str(r["head"]), str(r["tail"]), r["score"]) for r in done.collect())
    got = relations.deduplicate_edges(edges).collect()
    assert Counter((r["doc_id"], str(r["head"]), str(r["tail"]), r["score"]) for r in got) == want
    for d in range(40):
        own = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(1, len(own) + 1))
        assert [(r["head"]["start"], r["tail"]["start"], -r["score"]) for r in own] == sorted((r["head"]["start"], r["tail"]["start"], -r["score"]) for r in own)
    plan = relations.deduplicate_edges(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 10


# -- ragged preparation of records


@pytest.mark.parametrize("mode", ["natural", "latent", "anchorless"])
def test_prepared_groups_by_brute_force(spark, mode):
    rng = random.Random(6)
    fields = [CompiledField(1, "a", "required_one", False), CompiledField(0, "b", "zero_or_more", False), CompiledField(2, "c", "optional_one", False)]
    live = {0, 1}
    pools = {d: [(s, s + rng.randrange(1, 4)) for s in rng.sample(range(30), rng.randrange(6))] for d in range(12)}
    logits = {(d, k): [rng.random() for _ in range(3)] for d, own in pools.items() for k in range(len(own))}
    rows = [(d, k, *x, logits[d, k]) for d, own in pools.items() for k, x in enumerate(own)]
    rng.shuffle(rows)
    candidates = spark.createDataFrame(rows, "doc_id long, slot int, start int, end int, logits array<double>")
    docs = spark.createDataFrame([(d,) for d in pools], "doc_id long")
    prepared = records.prepared_groups(candidates, docs, fields, mode, "a" if mode == "natural" else None, live, anchorless=3)
    got = {r["doc_id"]: r for r in prepared.collect()}
    outputs, widest = [], max(map(len, pools.values()))
    for d, own in pools.items():
        n = len(own)
        context = [*range(n), *range(n)]  # fields a and b; c's query isn't live
        seeds = {"natural": [(0, k, *own[k], logits[d, k][1]) for k in range(n)], "latent": [(f, k, *own[k], 0.0) for f in (0, 1) for k in range(n)], "anchorless": [(None, None, None, None, 0.0)] * 3}[mode]
        if not seeds:
            assert d not in got
            continue
        r = got[d]
        assert [tuple(x) for x in r["spans"]] == own and r["offsets"] == [0, n, 2 * n, 2 * n] and r["context"] == context
        assert [tuple(x) for x in r["seeds"]] == seeds
        # A model's outputs are padded to the widest text; what fills up is huge, so that it would show.
        objects = [rng.uniform(-2, 2) for _ in seeds] + [99.0] * 5
        assigns = [[[rng.uniform(-2, 2) for _ in range(1 + (n if f < 2 else 0))] + [99.0] * (widest - (n if f < 2 else 0)) for f in range(3)] for _ in range(len(seeds) + 5)]
        outputs.append((d, objects, assigns))
    model = spark.createDataFrame(outputs, "doc_id long, object_logits array<double>, assign_logits array<array<array<double>>>")
    objects, assigns = records.unpadded(prepared, model, "s", fields)
    want_objects, want_assigns = Counter(), Counter()
    for d, o, a in outputs:
        own = pools[d]
        for i, seed in enumerate(got[d]["seeds"]):
            want_objects[d, i, o[i], seed["start"], seed["end"]] += 1
            for f, field in enumerate(fields):
                n = len(own) if f < 2 else 0
                for col in range(n + 1):
                    want_assigns[(d, field.name, i, col, a[i][f][col], *(own[col - 1] if col else (None, None)))] += 1
    assert Counter((r["doc_id"], r["instance"], r["logit"], r["seed_start"], r["seed_end"]) for r in objects.collect()) == want_objects
    assert Counter((r["doc_id"], r["field"], r["instance"], r["col"], r["logit"], r["start"], r["end"]) for r in assigns.collect()) == want_assigns
    decoded = records.decode_records(objects, assigns, fields, mode, "a" if mode == "natural" else None, 0.3, 0.3, 0.3).collect()
    assert decoded and all(r["score"] < 0.999 for r in decoded)


# -- streams, configurations, batches


def test_decoding_scores_that_rows_bring_along(spark):
    rows = [(1, "a b c", [(0, 1, 2.0), (0, 2, 3.0), (2, 3, -5.0)]), (2, "x", None), (3, None, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, scores array<struct<start:int,end:int,logit:double>>")
    query = prompts.Query(0, "entity", "entities", "person")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in decode(docs, query, ColumnProvider({"person": "scores"}), 0.5, "greedy").collect()}
    assert got == {1: [(0, 2)], 2: [], 3: []}
    with pytest.raises(ValueError):
        decode(docs, prompts.Query(1, "entity", "entities", "place"), ColumnProvider({"person": "scores"}), 0.5, "greedy")


def test_a_replayed_batch_doubles_no_row(spark, tmp_path):
    write = by_batch(str(tmp_path / "out"), lambda batch: spans.grid(batch.withColumn("n_words", F.lit(3))))
    batch = spark.createDataFrame([(1,), (2,)], "doc_id long")
    for number in (0, 1, 1, 0):
        write(batch.filter(F.col("doc_id") == number + 1), number)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 12 and got.distinct().count() == 12


def test_boundary_configurations(tmp_path):
    path = tmp_path / "config.json"
    head = {**PINNED, "rotary_base": 10000, "pool_size": 20, "min_pool_per_query": 4, "pair_temperature": 2.5, "relation_argument_proposal_threshold": 0.1, "overlap_policy": "nested"}
    path.write_text(json.dumps({"architecture": "boundary", "architecture_version": 1, "model_name": "x", "token_pooling": "first", "max_len": 100, "boundary_head": head}))
    found = read_config(tmp_path)
    assert (found.pool_capacity, found.pool_per_query, found.pair_temperature, found.argument_threshold, found.overlap_policy, found.max_len) == (20, 4, 2.5, 0.1, "nested", 100)
    for changes in ({"boundary_dim": 64}, {"enable_records": False}, {"enable_records": 1}, {"candidate_pool": "own"}, {"rotary_base": 1}, {"pool_size": 2}, {"pool_size": True}, {"pair_temperature": 0}, {"overlap_policy": "x"}):
        path.write_text(json.dumps({"architecture": "boundary", "boundary_head": head | changes}))
        with pytest.raises(ValueError):
            read_config(tmp_path)
    for other in ({"architecture": "boundary", "token_pooling": "mean"}, {"architecture": "boundary", "boundary_head": 3}, {"architecture_version": 2}, {"architecture": "other"}):
        path.write_text(json.dumps(other))
        with pytest.raises(SchemaError):
            read_config(tmp_path)


def test_batches_are_no_larger(spark):
    import pyarrow as pa

    rows = spark.range(0, 100, 1, 3)
    sizes = batches(rows, 7, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]), "n long").collect()
    assert sum(r["n"] for r in sizes) == 100 and max(r["n"] for r in sizes) == 7


def test_caps_of_the_pool():
    assert PoolConfig() == PoolConfig(32, 192, 8) and (relations.HEADS, relations.TAILS, relations.PAIRS) == (32, 32, 64)
