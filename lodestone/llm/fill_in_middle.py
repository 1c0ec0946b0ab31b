"""Fill-in-the-middle: texts as ropes, cut at two unit ranks, rearranged round sentinels, and put back.

A unit is a word with the white space before it, or white space at the end. A rope is a balanced tree
over pieces of the text, cut between units; each node knows how many units and code points are below
it, so splitting at a rank walks one path and joining two ropes walks the difference of their heights.
A transformed text is rebuilt by cutting the rope of the output at its sentinels, found by their
places in code points, and joining prefix, middle and suffix again.

Which texts are transformed and where they are cut comes from a hash of a seed and the id alone.

Nulls: a null text is empty; a null id is hashed as an empty one and passed on. Texts that are empty
or hold a sentinel stay plain, and a plain output is its own text. Repeated rows are answered each
and, having one id, are cut alike. Very long texts are taken whole; a leaf is longer than LEAF only where
a single word is. Prefix, middle and suffix may be empty. There are no ties. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of

# Fixed values of the form: sentinels, seed, percentages of transformed texts and, of these, of those with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE, SPM_RATE = 50, 80
#: Code points of a leaf, about.
LEAF = 2048
#: Bytes of texts that are worked on at once.
SLICE = 2_000_000

_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
_WORD_ENDS = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


@dataclass(frozen=True, slots=True)
class Rope:
    """A node: a leaf has text, others two parts. ``units`` and ``chars`` count what is below."""

    units: int
    chars: int
    height: int = 0
    text: str = ""
    left: "Rope | None" = None
    right: "Rope | None" = None

    def leaves(self) -> Iterator[str]:
        waiting = [self]
        while waiting:
            node = waiting.pop()
            if node.left is None:
                yield node.text
            else:
                waiting += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


def leaf(text: str) -> Rope:
    return Rope(len(_UNIT.findall(text)), len(text), text=text)


EMPTY = leaf("")


def _node(left: Rope, right: Rope) -> Rope:
    return Rope(left.units + right.units, left.chars + right.chars, 1 + max(left.height, right.height), "", left, right)


def _balanced(left: Rope, right: Rope) -> Rope:
    """A node of two ropes whose heights differ by two at most, turned so that they differ by one."""
    if left.height > right.height + 1:
        if left.left.height >= left.right.height:
            return _node(left.left, _node(left.right, right))
        return _node(_node(left.left, left.right.left), _node(left.right.right, right))
    if right.height > left.height + 1:
        if right.right.height >= right.left.height:
            return _node(_node(left, right.left), right.right)
        return _node(_node(left, right.left.left), _node(right.left.right, right.right))
    return _node(left, right)


def joined(left: Rope, right: Rope) -> Rope:
    """One rope of two, by way of the higher one's edge."""
    if not left.chars or not right.chars:
        return right if not left.chars else left
    if left.height > right.height + 1:
        return _balanced(left.left, joined(left.right, right))
    if right.height > left.height + 1:
        return _balanced(joined(left, right.left), right.right)
    return _node(left, right)


def split(rope: Rope, at: int, by: str) -> tuple[Rope, Rope]:
    """The first ``at`` units or chars of a rope, and the rest."""
    if at <= 0:
        return EMPTY, rope
    if at >= getattr(rope, by):
        return rope, EMPTY
    if rope.left is None:
        place = at if by == "chars" else [m.end() for m in _UNIT.finditer(rope.text)][at - 1]
        return leaf(rope.text[:place]), leaf(rope.text[place:])
    before = getattr(rope.left, by)
    if at < before:
        first, rest = split(rope.left, at, by)
        return first, joined(rest, rope.right)
    if at > before:
        first, rest = split(rope.right, at - before, by)
        return joined(rope.left, first), rest
    return rope.left, rope.right


def rope_of(text: str, size: int = LEAF) -> Rope:
    """A text as a rope whose leaves end where units do."""
    level, at = [], 0
    while at < len(text):
        end = _WORD_ENDS.search(text, at + size)
        to = end.start() if end else len(text)
        level.append(leaf(text[at:to]))
        at = to
    while len(level) > 1:
        level = [_node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def transformed(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, int, str, int | None, int | None]:
    """Output, number of units, form, and code points of prefix and middle."""
    rope = rope_of(text)
    n = rope.units
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return text, n, "plain", None, None
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, rest = split(rope, first, "units")
    middle, suffix = split(rest, second - first, "units")
    form = "spm" if h4 % 100 < spm_rate else "psm"
    order = [leaf(SUFFIX), suffix, leaf(PREFIX), prefix] if form == "spm" else [leaf(PREFIX), prefix, leaf(SUFFIX), suffix]
    out = EMPTY
    for part in (*order, leaf(MIDDLE), middle):
        out = joined(out, part)
    return str(out), n, form, prefix.chars, middle.chars


def restored(output: str, form: str) -> str:
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    rope, parts = rope_of(output), {}
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    for sentinel in reversed(order):
        rope, part = split(rope, output.index(sentinel), "chars")
        parts[sentinel] = split(part, len(sentinel), "chars")[1]
    return str(joined(joined(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b"")).alias("t"))


def transform_texts(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, output, form, n, prefix_chars, middle_chars) for each row of doc_id and text."""

    def run(batches):
        for batch in batches:
            for at, texts in slices_of(batch.column(1), SLICE):
                ids = batch.column(0).slice(at, len(texts))
                output, n, form, prefix, middle = zip(*(transformed(t.decode(), i, seed, rate, spm_rate) for t, i in zip(texts, ids.to_pylist())))
                yield pa.RecordBatch.from_arrays([ids, pa.array(output, pa.string()), pa.array(form, pa.string()), pa.array(n, pa.int64()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())], ["doc_id", "output", "form", "n", "prefix_chars", "middle_chars"])

    return _rows(docs).mapInArrow(run, "doc_id long, output string, form string, n long, prefix_chars long, middle_chars long")


def restore_texts(outputs: DataFrame) -> DataFrame:
    """(doc_id, text) for each row of doc_id, output and form; null outputs are empty, null forms plain."""

    def run(batches):
        for batch in batches:
            forms = batch.column(2).to_pylist()
            for at, texts in slices_of(batch.column(1), SLICE):
                back = [restored(t.decode(), forms[at + i] or "plain") for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(back, pa.string())], ["doc_id", "text"])

    return outputs.select("doc_id", F.coalesce(F.encode("output", "UTF-8"), F.lit(b"")).alias("output"), "form").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame) -> DataFrame:
    """What transform_texts gives, with digests of the output and of the text rebuilt from it in place of the output."""

    def run(batches):
        for batch in batches:
            for at, texts in slices_of(batch.column(1), SLICE):
                ids = batch.column(0).slice(at, len(texts))
                rows = []
                for t, i in zip(texts, ids.to_pylist()):
                    output, n, form, prefix, middle = transformed(t.decode(), i)
                    rows.append((n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(restored(output, form).encode()).hexdigest()))
                n, form, prefix, middle, out, back = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out), pa.array(back)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    return round_trip_digests(docs)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
