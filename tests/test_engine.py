import hashlib
import json

import pytest

from lodestone.engine import Engine, Unsupported
from lodestone.plans.schema import RecordOptions, SchemaBuilder, SchemaError
from lodestone.providers.hashing import HashingProvider
from lodestone.providers.onnx import check_signature
from lodestone.sources import bundle
from lodestone.sources.config import ModelConfig, RuntimeOptions, read_config
from lodestone.sources.readers import batches, read_labelled, read_texts
from lodestone.streaming.rowlocal import decode, decode_stream


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "Ada Lovelace met Charles Babbage in London. They worked hard"), (2, "hello world"), (3, ""), (4, None)], "doc_id long, text string")


@pytest.mark.parametrize("architecture", ["span", "boundary"])
def test_extract_gives_every_document(spark, docs, architecture):
    schema = SchemaBuilder().entities("person").relation("knows").classification("mood", ["good", "bad"]).structure("event", ["who::str", "kind::[x|y]"]).build()
    rows = Engine(HashingProvider(), ModelConfig(architecture=architecture)).extract(docs, schema, 0.6, True, True).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3, 4]
    for r in rows:
        assert set(r["entities"]) == {"person"} and set(r["relations"]) == {"knows"} and set(r["classifications"]) == {"mood"}
        text = next(d["text"] for d in docs.collect() if d["doc_id"] == r["doc_id"]) or ""
        for e in r["entities"]["person"]:
            assert text.encode()[e["start"] : e["end"]].decode().strip() == e["text"] and e["confidence"] >= 0.6
    empty = next(r for r in rows if r["doc_id"] == 3)["structures"]  # a choice may come from the prefix alone, a span can't
    assert all('"who"' not in record for record in (empty or {}).get("event", [])) and (empty is not None or architecture == "boundary")


def test_what_architectures_refuse(docs):
    span, boundary = Engine(HashingProvider()), Engine(HashingProvider(), ModelConfig(architecture="boundary"))
    schema = SchemaBuilder().entities("a").build()
    for call in (lambda: span.set_overlap_policy("flat"), lambda: span.set_word_splitter("char"), lambda: span.score_explicit_spans(docs, ["x"], docs), lambda: span.extract_json(docs, {"s": ["a"]}, record_options={"s": RecordOptions()}), lambda: boundary.infer_raw(docs, schema)):
        with pytest.raises(Unsupported):
            call()
    with pytest.raises(SchemaError):
        span.extract(docs, schema, 1.5)
    assert span.infer_raw(docs, schema).count() > 0


def test_relations_trim_as_python(spark):
    docs = spark.createDataFrame([(1, "a\u3000b\tc \x1c d")], "doc_id long, text string")
    e = Engine(HashingProvider(), ModelConfig(architecture="boundary"))
    edges = [x for r in e.batch_extract_relations(docs, ["r"], 0.0, batch_size=1).collect() for x in r["relations"]["r"]]
    assert edges and all(x[s]["text"] == x[s]["text"].strip() for x in edges for s in ("head", "tail"))
    with pytest.raises(ValueError):
        e.batch_extract_relations(docs, ["r"], batch_size=0)


def test_adapters(docs):
    e = Engine(HashingProvider(4), adapters={"narrow": HashingProvider(1)})
    schema = SchemaBuilder().entities("a").build()
    wide = e.infer_raw(docs, schema).count()
    e.load_adapter("narrow")
    assert e.has_adapter and e.infer_raw(docs, schema).count() < wide
    e.unload_adapter()
    assert not e.has_adapter and e.infer_raw(docs, schema).count() == wide


def test_explicit_spans(spark, docs):
    e = Engine(HashingProvider(), ModelConfig(architecture="boundary"))
    ask = lambda *rows: spark.createDataFrame(rows, "doc_id long, span_idx int, byte_start int, byte_end int")
    rows = {r["doc_id"]: r["scores"] for r in e.score_explicit_spans(docs, ["x"], ask((1, 0, 4, 12), (1, 1, 0, 3), (1, 2, 4, 12))).collect()}
    assert [(s["start"], s["end"]) for s in rows[1][0]["spans"]] == [(1, 2), (0, 1), (1, 2)] and rows[2][0]["spans"] == []
    assert all(r["scores"] == [] for r in e.score_explicit_spans(docs, [], ask((1, 0, 0, 3))).collect())
    with pytest.raises(Exception, match="doesn't fit"):
        e.score_explicit_spans(docs, ["x"], ask((1, 0, 1, 3))).collect()


def test_config(tmp_path):
    assert read_config(tmp_path) == ModelConfig() and ModelConfig(architecture="boundary").word_cap == 4096
    (tmp_path / "config.json").write_text('{"architecture": "boundary", "max_len": 7}')
    assert read_config(tmp_path).word_cap == 7
    for bad in ('[1]', '{"max_len": 0}', '{"relation_temperature": 0}', '{"abstention_threshold": 2}', '{"overlap_policy": "x"}', '{"max_len": 1, "max_len": 2}'):
        (tmp_path / "config.json").write_text(bad)
        with pytest.raises(ValueError):
            read_config(tmp_path)
    for bad in ({"provider": "gpu"}, {"threads": 0}, {"optimization": "most"}):
        with pytest.raises(ValueError):
            RuntimeOptions(**bad)


def test_bundle(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.bin").write_bytes(b"a")
    (tmp_path / "sub/b.bin").write_bytes(b"bb")

    def manifest(**changes):
        files = [{"path": p, "bytes": len(c), "sha256": hashlib.sha256(c).hexdigest()} for p, c in (("a.bin", b"a"), ("sub/b.bin", b"bb"))]
        files[0] |= changes
        (tmp_path / "manifest.json").write_text(json.dumps({"files": files}))

    manifest()
    bundle.validate_bundle(spark, str(tmp_path))
    (tmp_path / "c.bin").write_bytes(b"c")
    (tmp_path / "sub/b.bin").write_bytes(b"bc")
    found = {r["path"]: r["problem"] for r in bundle.differences(spark, str(tmp_path)).collect()}
    assert found == {"c.bin": "not listed", "sub/b.bin": "digest"}
    for bad in ("../x", "/x", "a\\b", "a//b", "./a", ""):
        with pytest.raises(bundle.BundleError):
            bundle.safe_path(bad)
    for bad in (b"{", b'{"files": []}', b'{"files": [], "files": []}'):
        with pytest.raises(ValueError):
            bundle.read_manifest(bad)
    assert bundle.missing_files(["config.json"]) == ["tokenizer.json", "encoder.onnx", "classifier.onnx"]


def test_signature():
    check_signature(["a"], ["x", "y"], ["a"], ["x"])
    for found in ((["a", "b"], ["x"]), ([], ["x"]), (["a"], [])):
        with pytest.raises(ValueError):
            check_signature(*found, ["a"], ["x"])


def test_readers(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"text": "a b", "entities": {"x": ["a"]}}\n')
    assert read_labelled(spark, str(tmp_path / "t.jsonl")).first()["entities"] == {"x": ["a"]}
    assert [r["text"] for r in read_texts(spark, str(tmp_path / "t.jsonl"), "json").collect()] == ["a b"]
    assert read_texts(spark, str(tmp_path / "t.jsonl"), "text").count() == 1
    with pytest.raises(ValueError):
        batches(None, 0)


def test_stream_equals_batch(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    decode_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = decode(source, 0, 4, 0.99, "greedy")
    assert got.exceptAll(want).isEmpty() and got.count() == source.count()
