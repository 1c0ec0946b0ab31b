"""Prompt tokens of a schema and the queries that they route to."""

from __future__ import annotations

from dataclasses import dataclass

from .schema import Classification, Entity, Relation, Schema, Structure

STRUCTURE_SEPARATOR, TEXT_SEPARATOR = "[SEP_STRUCT]", "[SEP_TEXT]"


def _prompt(head: str, marker: str, names, described=()) -> list[str]:
    head += "".join(f" [DESCRIPTION] {name}: {text}" for name, text in described if name in names)
    return ["(", "[P]", head, "(", *(x for name in names for x in (marker, name)), ")", ")"]


def _titled(name: str, prompt: str | None) -> str:
    return f"{name}: {prompt}" if prompt else name


def entity_prompt(entities: tuple[Entity, ...], prompt: str | None = None) -> list[str]:
    return _prompt(_titled("entities", prompt), "[E]", [e.name for e in entities], [(e.name, e.description) for e in entities if e.description is not None])


def classification_prompt(task: Classification) -> list[str]:
    return _prompt(_titled(task.task, task.prompt), "[L]", list(task.labels), task.descriptions)


def relation_prompt(relation: Relation) -> list[str]:
    return _prompt(_titled(relation.name, relation.description), "[R]", ["head", "tail"])


def structure_prompt(structure: Structure, prompt: str | None = None) -> list[str]:
    return _prompt(_titled(structure.name, prompt), "[C]", [f.name for f in structure.fields], [(f.name, f.description) for f in structure.fields if f.description is not None])


def choice_prefix(structure: Structure) -> list[str]:
    """``( name: field ( a | b ) , field ( c ) )`` of the fields with choices; nothing if there are none."""
    parts = []
    for f in structure.fields:
        if f.choices:
            if parts:
                parts.append(",")
            choices = [x for c in f.choices for x in ("|", c)][1:]
            parts += [f.name, "(", *choices, ")"]
    return ["(", f"{structure.name}:", *parts, ")"] if parts else []


@dataclass(frozen=True)
class Query:
    query_id: int
    kind: str  # entity, content or relation
    owner: str
    name: str
    threshold: float | None = None


def prompts_of(schema: Schema) -> list[list[str]]:
    """Prompts in the order structures, entities, relations, classifications."""
    out = [structure_prompt(s) for s in schema.structures]
    if schema.entities:
        out.append(entity_prompt(schema.entities))
    out += [relation_prompt(r) for r in schema.relations]
    return out + [classification_prompt(c) for c in schema.classifications]


def joined(prompts: list[list[str]], prefix: list[str], words: list[str]) -> list[str]:
    """All prompts, then the text; a prefix of choices stands before the words."""
    out = []
    for i, p in enumerate(prompts):
        out += ([STRUCTURE_SEPARATOR] if i else []) + p
    return [*out, TEXT_SEPARATOR, *prefix, *words]


def routes(schema: Schema) -> list[Query]:
    """One query for each [C], [E] and [R] marker, numbered in the order of the prompts."""
    found = [("content", s.name, f.name, f.threshold) for s in schema.structures for f in s.fields]
    found += [("entity", "entities", e.name, e.threshold) for e in schema.entities]
    found += [("relation", r.name, side, r.threshold) for r in schema.relations for side in ("head", "tail")]
    return [Query(i, *x) for i, x in enumerate(found)]
