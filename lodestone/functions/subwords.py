"""Sub-words of words: each word is encoded on its own and keeps its place."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .slices import by_slices

PIECES = "array<struct<piece:string,id:int,word:int>>"
_tokenizers: dict = {}


def tokenizer(path: str):
    """One tokenizer for a worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def encode_words(words: list[str], path: str, unknown: str = "[UNK]") -> list[dict]:
    """Pieces without special tokens; a word without any is the unknown token, if the vocabulary has one."""
    t = tokenizer(path)
    out = []
    for i, e in enumerate(t.encode_batch(words, add_special_tokens=False)):
        if e.ids:
            out += [{"piece": p, "id": x, "word": i} for p, x in zip(e.tokens, e.ids, strict=True)]
        elif (x := t.token_to_id(unknown)) is not None:
            out.append({"piece": unknown, "id": x, "word": i})
    return out


#: A worker keeps the pieces of so many distinct words, then begins anew.
KEPT = 1 << 17


class Known:
    """Pieces of words met so far: the words' numbers, and all their pieces' ids with where each word's begin."""

    def __init__(self, path: str, unknown: str = "[UNK]"):
        t = self.tokenizer = tokenizer(path)
        self.names = pa.array([t.id_to_token(i) for i in range(max(t.get_vocab().values()) + 1)], pa.string())
        self.nothing = [] if t.token_to_id(unknown) is None else [t.token_to_id(unknown)]
        self.numbers: dict[str, int] = {}
        self.ids, self.begins = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, words: list[str]) -> None:
        found = [e.ids or self.nothing for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        self.numbers.update(zip(words, range(len(self.numbers), len(self.numbers) + len(words))))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32)])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(x) for x in found])])


_known: dict[str, Known] = {}


def encode_lists(lists: pa.ListArray, path: str) -> pa.ListArray:
    """encode_words() of some texts' words at once; a word that they repeat, or that the worker has met, isn't encoded again."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if path not in _known or len(_known[path].numbers) > KEPT:
        _known[path] = Known(path)
    known = _known[path]
    if new := [w for w in words if w not in known.numbers]:
        known.add(new)
    number = np.array([known.numbers[w] for w in words], np.int64)
    of = number[coded.indices.to_numpy(zero_copy_only=False)]
    first, many = known.begins[of], known.begins[of + 1] - known.begins[of]
    total = np.cumsum(many)
    at = np.repeat(first - (total - many), many) + np.arange(int(total[-1]) if len(total) else 0)
    word = np.repeat(np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts), many)
    ids = pa.array(known.ids[at])
    flat = [known.names.take(ids), ids, pa.array(word.astype(np.int32))]
    ends = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(flat, ["piece", "id", "word"]), mask=lists.is_null())


def with_subwords(df: DataFrame, words: str, path: str, name: str = "subwords") -> DataFrame:
    """Adds the pieces of an array of words; the first piece of a word stands for it (first_pieces)."""
    return df.withColumn(name, by_slices(PIECES, lambda lists: encode_lists(lists, path)).asNondeterministic()(F.col(words)))


def first_pieces(subwords: str) -> F.Column:
    """The pieces that stand for their words: the first of each."""
    return F.filter(F.col(subwords), lambda x, i: (i == 0) | (F.element_at(F.col(subwords), F.greatest(i, F.lit(1)))["word"] != x["word"]))
