import pytest

from lodestone.plans.prompts import choice_prefix, classification_prompt, entity_prompt, joined, prompts_of, relation_prompt, routes, structure_prompt
from lodestone.plans.schema import Classification, Entity, RecordField, RecordOptions, Relation, SchemaBuilder, SchemaError, Structure, Validator, compile_records, parse_field, validate_task


def test_field_specs():
    assert parse_field("name").dtype == "list"
    assert parse_field("name::str::full name").description == "full name"
    f = parse_field("kind::[Red | Blue]::a::b")
    assert (f.dtype, f.choices, f.description) == ("str", ("Red", "Blue"), "a::b")
    assert parse_field("kind::[a]::list").dtype == "list"
    assert parse_field("x::STR::list").dtype == "list"
    for bad in ("", " :: str", "k::[ | ]"):
        with pytest.raises(SchemaError):
            parse_field(bad)


def test_builder_updates_in_place():
    s = SchemaBuilder().entity("a", "first", threshold=0.3).entity("b").entity("a", dtype="str").build()
    assert [(e.name, e.description, e.dtype, e.threshold) for e in s.entities] == [("a", "first", "str", 0.3), ("b", None, "list", None)]
    s = SchemaBuilder().classification("t", ["x"]).classification("t", ["x"]).build()
    assert len(s.classifications) == 2


@pytest.mark.parametrize("task", [Classification("t", ()), Classification("t", ("a", "a")), Classification("t", ("a",), descriptions=(("b", "x"),)), Classification("t", ("[L] a",)), Classification("t", ("a",), threshold=float("nan")), Classification("t", ("a",), activation="tanh")])
def test_bad_tasks(task):
    with pytest.raises(SchemaError):
        validate_task(task)


def test_prompts():
    assert entity_prompt((Entity("a", "what a is"), Entity("b"))) == ["(", "[P]", "entities [DESCRIPTION] a: what a is", "(", "[E]", "a", "[E]", "b", ")", ")"]
    assert classification_prompt(Classification("t", ("x",), prompt="pick")) == ["(", "[P]", "t: pick", "(", "[L]", "x", ")", ")"]
    assert relation_prompt(Relation("r", "d")) == ["(", "[P]", "r: d", "(", "[R]", "head", "[R]", "tail", ")", ")"]
    s = Structure("kind", (parse_field("c::[Red|Blue]"), parse_field("x"), parse_field("d::list::[u]")))
    assert structure_prompt(s)[3:9] == ["(", "[C]", "c", "[C]", "x", "[C]"]
    assert choice_prefix(s) == ["(", "kind:", "c", "(", "Red", "|", "Blue", ")", ",", "d", "(", "u", ")", ")"]
    assert choice_prefix(Structure("s", (parse_field("x"),))) == []
    assert joined([["a"], ["b"]], ["p"], ["w"]) == ["a", "[SEP_STRUCT]", "b", "[SEP_TEXT]", "p", "w"]


def test_routes_follow_prompts():
    s = SchemaBuilder().entities("e").relation("r").structure("s", ["f", "g"]).classification("t", ["a"]).build()
    assert [(q.kind, q.owner, q.name) for q in routes(s)] == [("content", "s", "f"), ("content", "s", "g"), ("entity", "entities", "e"), ("relation", "r", "head"), ("relation", "r", "tail")]
    assert [p[2] for p in prompts_of(s)] == ["s", "entities", "r", "t"]


def test_records_compile():
    s = Structure("s", (parse_field("a::str"), parse_field("b::str"), parse_field("c")))
    got = compile_records(s, RecordOptions("natural", "a", {"c": RecordField("one_or_more", False)}))
    assert [(f.cardinality, f.exclusive) for f in got] == [("required_one", True), ("optional_one", True), ("one_or_more", False)]
    for bad in (RecordOptions("natural"), RecordOptions("latent", "a"), RecordOptions("other"), RecordOptions("latent", None, {"z": RecordField()})):
        with pytest.raises(SchemaError):
            compile_records(s, bad)


def test_validators_refuse_lookaround():
    with pytest.raises(SchemaError):
        Validator("(?=a)")
