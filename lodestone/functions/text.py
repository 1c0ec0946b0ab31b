"""Words of texts: splitting, capping, terminal punctuation, offsets.

Word lists without offsets are column expressions and stay in the JVM. Offsets need one pass with
a matcher that reports positions and come from an Arrow function.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import by_slices

# The alternatives of the word splitters, tried in this order at each place.
URL = r"https?://[^\s]+|www\.[^\s]+"
EMAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
HANDLE = r"@[a-z0-9_]+"
WORD = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*"
SPAN_WORD = r"\w+(?:[-_]\w+)*"
CHARACTER_RUN = r"[A-Za-z0-9@._+\-]+"
ANY = r"\S"
WORD_CAP = 4096

#: Span splitter with Unicode word characters, for the JVM's matcher.
SPAN_PATTERN = f"(?iU)(?:{URL}|{EMAIL}|{HANDLE}|{SPAN_WORD}|{ANY})"
#: White-space splitter: letters, digits and the underscore, without combining marks.
BOUNDARY_PATTERN = f"(?iu)(?:{URL}|{EMAIL}|{HANDLE}|{WORD}|{ANY})"
CHARACTER_PATTERN = f"(?:{CHARACTER_RUN}|{ANY})"
PATTERNS = {"span": SPAN_PATTERN, "whitespace": BOUNDARY_PATTERN, "char": CHARACTER_PATTERN}

#: The same for Python's matcher, whose \w leaves marks out and whose \s has U+001C to U+001F.
_PYTHON = {
    "whitespace": re.compile(f"(?:{URL}|{EMAIL}|{HANDLE}|{SPAN_WORD}|{ANY})", re.IGNORECASE),
    "char": re.compile(f"(?:{CHARACTER_RUN}|{ANY})"),
}
_PYTHON["span"] = _PYTHON["whitespace"]


def words(text: Column | str, splitter: str = "whitespace") -> Column:
    """The words of a text as an array; null for a null text."""
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(PATTERNS[splitter]), F.lit(0))


def capped(tokens: Column, cap: int | None = WORD_CAP) -> Column:
    """The first words up to the cap; no cap if None."""
    return tokens if cap is None else F.slice(tokens, 1, cap)


def with_prefix(tokens: Column, prefix: list[str], cap: int | None = None) -> Column:
    """A prefix before the capped words; the prefix doesn't count against the cap."""
    return F.concat(F.array(*map(F.lit, prefix)).cast("array<string>"), capped(tokens, cap))


def punctuated(text: Column | str) -> Column:
    """The text, with a period after it unless its last character is . ! or ?"""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"[.!?]\z"), text).otherwise(F.concat(text, F.lit(".")))


def coverage(start: Column, end: Column, length: Column) -> Column:
    """How much of a word [start, end) of the punctuated text the original of the given length holds."""
    return F.when(end <= length, "original").when(start < length, "original_with_synthetic_suffix").otherwise("synthetic_only")


def python_words(text: str, splitter: str = "whitespace") -> list[tuple[str, int, int]]:
    """Words of a text with code-point offsets, by Python's matcher."""
    return [(m.group(), m.start(), m.end()) for m in _PYTHON[splitter].finditer(text)]


def prepared(text: str, splitter: str = "whitespace", cap: int | None = WORD_CAP, prefix: tuple[str, ...] = ()) -> dict:
    """One text made ready: normalised text, words in lower case, UTF-8 offsets in the original with coverage, and what the cap cut off.

    Offsets end where the original text ends, so that the period added to it is never given out.
    """
    normal = text if text.endswith((".", "!", "?")) else text + "."
    limit = len(text.encode())
    found, offsets, position, byte = [], [], 0, 0
    all_words = python_words(normal, splitter)
    for word, start, end in all_words[: len(all_words) if cap is None else cap]:
        byte += len(normal[position:start].encode())
        stop = byte + len(word.encode())
        kind = "original" if stop <= limit else "original_with_synthetic_suffix" if byte < limit else "synthetic_only"
        offsets.append((min(byte, limit), min(stop, limit), kind))
        found.append(word.lower())
        position, byte = end, stop
    return {"normalized": normal, "tokens": [*prefix, *found], "words": found, "offsets": offsets, "prefix_words": len(prefix), "synthetic_suffix": normal != text, "truncated_words": len(all_words) - len(found)}


TOKENS = "array<struct<token:string,start:int,end:int,char_start:int,char_end:int>>"


def byte_places(text: str) -> np.ndarray | None:
    """For each code point, and the end, the bytes before it; None where they are the same."""
    if text.isascii():
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate([[0], np.cumsum(widths)])


@cache
def _kinds() -> np.ndarray:
    """Of each code point of the first plane: 1 for a word's, 2 for white space, 0 for others, as Python's matcher has them."""
    kinds = np.zeros(0x10000, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        kinds[i] = 1 if c.isalnum() or c == "_" else 2 * c.isspace()
    return kinds


def plain_places(text: str) -> np.ndarray:
    """Where words begin and end, as rows of code points, in a text without URLs, addresses and handles: runs of word characters, with
    single hyphens between two of them, and single other characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[np.minimum(points, 0xFFFF)]
    for c in np.unique(points[points > 0xFFFF]):
        kind[points == c] = chr(c).isalnum()
    run = kind == 1
    if len(run) > 2:
        run[1:-1] |= (points[1:-1] == ord("-")) & run[:-2] & run[2:]
    begins, ends = kind != 2, kind != 2
    begins[1:] &= ~(run[1:] & run[:-1])
    ends[:-1] &= ~(run[:-1] & run[1:])
    return np.stack([np.flatnonzero(begins), np.flatnonzero(ends) + 1], axis=1).astype(np.int32)


def is_plain(text: str) -> bool:
    """Whether no URL, address or handle can be in the text."""
    return "@" not in text and "://" not in text and "www." not in text.lower()


PLACES = "struct<start:array<int>,end:array<int>,char_start:array<int>,char_end:array<int>>"


def found_places(values: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text where its words begin and end, as rows of bytes and of code points."""
    find = _PYTHON["whitespace"].finditer
    plain = [is_plain(v) for v in values]
    # Plain texts are searched as one, with white space between them.
    told = plain_places("\n".join(v for v, p in zip(values, plain) if p))
    begins = np.ascontiguousarray(told[:, 0])
    parts, at, begun = [], 0, 0
    for value, p in zip(values, plain):
        if p:
            stop = at + int(np.searchsorted(begins[at:], np.int32(begun + len(value))))
            chars, at, begun = told[at:stop] - begun, stop, begun + len(value) + 1
        else:
            chars = np.array([m.span() for m in find(value)], np.int32).reshape(-1, 2)
        of = byte_places(value)
        parts.append((chars if of is None else of[chars].astype(np.int32), chars))
    return parts


def with_places(df: DataFrame, text: str = "text", name: str = "places") -> DataFrame:
    """Adds where with_offsets() finds words, without the words: an array for each side in UTF-8 and code points. Null texts have none."""

    def places(texts: pa.Array) -> pa.Array:
        parts = found_places([v or "" for v in texts.to_pylist()])
        ends = pa.array(np.cumsum([0, *(len(c) for _, c in parts)]).astype(np.int32))
        sides = [pa.array(np.concatenate([p[i][:, side] for p in parts])) for i in (0, 1) for side in (0, 1)]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, s) for s in sides], ["start", "end", "char_start", "char_end"])

    return df.withColumn(name, by_slices(PLACES, places).asNondeterministic()(F.col(text)))


def with_counts(df: DataFrame, text: str = "text", name: str = "n_words") -> DataFrame:
    """Adds the number of a text's words."""
    count = by_slices("int", lambda texts: pa.array([len(c) for _, c in found_places([v or "" for v in texts.to_pylist()])], pa.int32()))
    return df.withColumn(name, count.asNondeterministic()(F.col(text)))


def with_places_of(df: DataFrame, text: str, asked: Column, most: Column, name: str) -> DataFrame:
    """Adds an array of where spans of words stand, and what they say: start, end, char_start, char_end, text, and null for a span
    that isn't among the first so many words of its text. Words neither begin nor end with white space. asked: an array of (start, end) in words."""
    sides = ["start", "end", "char_start", "char_end"]

    def places(rows: pa.StructArray) -> pa.Array:
        texts, spans, limits = rows.flatten()
        values = [v or "" for v in texts.to_pylist()]
        counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        first, stop = (x.to_numpy(zero_copy_only=False) for x in spans.flatten().flatten())
        found = found_places(values)
        limit = np.minimum([len(c) for _, c in found], limits.to_numpy(zero_copy_only=False))
        inside = (first >= 0) & (first < stop) & (stop <= np.repeat(limit, counts))
        told, cuts = np.zeros((4, len(first)), np.int32), np.concatenate([[0], np.cumsum(counts)])
        said = np.full(len(first), None, object)
        for value, (in_bytes, chars), a, b in zip(values, found, cuts[:-1], cuts[1:]):
            own = a + np.flatnonzero(inside[a:b])
            told[:, own] = in_bytes[first[own], 0], in_bytes[stop[own] - 1, 1], chars[first[own], 0], chars[stop[own] - 1, 1]
            said[own] = [value[s:e] for s, e in told[2:, own].T.tolist()]
        items = pa.StructArray.from_arrays([*(pa.array(x) for x in told), pa.array(said, pa.string())], [*sides, "text"], mask=pa.array(~inside))
        return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), items)

    kind = "array<struct<" + ",".join(f"{s}:int" for s in sides) + ",text:string>>"
    return df.withColumn(name, by_slices(kind, places).asNondeterministic()(F.struct(F.col(text), asked, most)))


def with_offsets(df: DataFrame, text: str = "text", name: str = "tokens", splitter: str = "whitespace", cap: int | None = None) -> DataFrame:
    """Adds words with UTF-8 and code-point offsets. Null texts give null. Words are split once, whatever filters follow."""
    find = _PYTHON[splitter].finditer

    def offsets(texts: pa.Array) -> pa.Array:
        found, places, counts, missing = [], [], [], []
        for value in texts:
            value = value.as_py()
            missing.append(value is None)
            before, spans = len(found), []
            for m in islice(find(value or ""), cap):
                found.append(m.group())
                spans.append(m.span())
            counts.append(len(found) - before)
            if spans:
                chars = np.array(spans, np.int64)
                of = byte_places(value)
                places.append(np.concatenate([chars if of is None else of[chars], chars], axis=1))
        columns = np.concatenate(places).astype(np.int32).T if places else np.zeros((4, 0), np.int32)
        words = pa.StructArray.from_arrays([pa.array(found, pa.string()), *(pa.array(c) for c in columns)], ["token", "start", "end", "char_start", "char_end"])
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, words, mask=pa.array(missing, pa.bool_()))

    return df.withColumn(name, by_slices(TOKENS, offsets).asNondeterministic()(F.col(text)))
