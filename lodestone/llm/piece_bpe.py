"""SentencePiece BPE: exact encoding by backtracking over longest matches, and decoding.

Merging takes, again and again, the pair of neighbours whose joined piece scores highest (of equal ones the
leftmost). A sequence of pieces is the result for a text exactly if each two neighbours, merged anew
from their characters, come out as these two: up to the first merge across a border, merges on both
sides of it run as they would for the two alone. So every prefix of a text has one last piece only.

Encoding finds, with an Aho-Corasick automaton of all pieces, the longest piece that starts at each
place, and goes from left to right: it takes the longest piece that agrees with the one before, tries
shorter ones (prefixes that are pieces), and where none fits marks the place as failed in a bitfield and
takes the last piece back. As a place is only ever reached by one sequence, a failed one is never
tried again, and work is linear in the text.

A text is cut where the model has no piece across the border: as a rule before spaces and marks that
follow a letter, and around characters that no merge can take. The pieces of short segments are kept.
Characters without a piece become pieces of their UTF-8 bytes.

Nulls: a null text is empty: no pieces, the digests of nothing; a null doc_id is passed on. Empty
texts have no pieces either. Repeated rows are encoded each. Very long texts are taken whole, segment
by segment; a segment may be as long as its text. An empty table gives an empty result. Ties between
equal scores go to the left. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of

# Fixed values of the model format: field numbers, kinds of pieces, the model type, the mark of a space, what an unknown id decodes to.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "
#: Segments and pairs that a worker keeps, and how long a kept segment may be.
KEPT_SEGMENTS, KEPT_PAIRS, KEPT_LENGTH = 300_000, 400_000, 40
#: Bytes of texts that are worked on at once.
SLICE = 2_000_000


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message; values of a fixed size stay bytes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, message[at : at + size]
        at += size


class PieceModel:
    """A BPE model with byte fallback: pieces, scores and what may be done to a text before."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        trainer = {n: v for number, part in parts if number == TRAINER for n, v in fields(part)}
        shape = {n: v for number, part in parts if number == NORMALIZER for n, v in fields(part)}
        if trainer.get(3) != BPE:
            raise ValueError("not a BPE model")
        if shape.get(2) or shape.get(4, 1) or not shape.get(5, 1):
            raise ValueError("the model changes characters or drops spaces, which isn't supported")
        if trainer.get(24, 0):
            raise ValueError("the model treats spaces as suffixes, which isn't supported")
        self.dummy_prefix = bool(shape.get(3, 1))
        self.pieces, self.kinds, scores = [], [], []
        for piece in (dict(fields(part)) for number, part in parts if number == PIECES):
            self.pieces.append(piece[1].decode())
            self.kinds.append(piece.get(3, NORMAL))
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
        if set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has pieces of other kinds, which aren't supported")
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.score = {p: scores[i] for p, i in self.id_of.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        found = {self.pieces[i]: i for i, k in enumerate(self.kinds) if k == BYTE}
        #: The id of each byte; without such pieces an unknown character is the unknown id.
        self.byte_ids = [found[f"<0x{b:02X}>"] for b in range(256)] if found else None
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids or ())}


def borders(joined: list[str], joinable: set[str]) -> str:
    """A pattern that cuts a text into segments only where no piece has the character before next to that after.

    Letters and what may follow them in a piece are one class. Others begin a segment, which ends with letters.
    """
    before: dict[str, set[str]] = {}
    for piece in joined:
        for a, b in zip(piece, piece[1:]):
            before.setdefault(b, set()).add(a)
    word = {c for c in joinable if c.isalpha()}
    while more := {c for c in joinable - word if before.get(c, set()) & word}:
        word |= more
    rest, lead = joinable - word, ""
    if SPACE in rest and before.get(SPACE, set()) <= {SPACE}:  # nothing but spaces is joined with a space after it
        rest, lead = rest - {SPACE}, f"{SPACE}*"
    of = lambda chars: f"[{''.join(map(re.escape, sorted(chars)))}]" if chars else "(?!)"
    other = f"[^{''.join(map(re.escape, sorted(joinable)))}]" if joinable else r"(?s:.)"
    return f"{lead}(?:{of(rest)}+)?{of(word)}+|{lead}{of(rest)}+|{SPACE}+|{other}+"


class PieceBpe:
    """Encodes texts and decodes ids with a model."""

    def __init__(self, path: str):
        import ahocorasick

        self.model = model = PieceModel(path)
        joined = [p for p in model.id_of if len(p) > 1]
        joinable = {c for p in joined for c in p}
        #: What a text is cut into, numbered: pieces, and characters of longer ones. For each its length, and its longest proper prefix among them or -1.
        self.tokens = sorted(set(joined) | joinable)
        number = {t: k for k, t in enumerate(self.tokens)}
        self.length = [len(t) for t in self.tokens]
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.tokens]
        self.ids_of = [tuple(self._ids(t)) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for t, k in number.items():
            self.automaton.add_word(t, k)
        if number:
            self.automaton.make_automaton()
        self.find = re.compile(borders(joined, joinable)).findall
        self.joinable = joinable
        self.agreeing: dict[int, bool] = {}
        self.segments: dict[str, tuple[tuple[int, ...], str]] = {}
        self.controls = {i for i, k in enumerate(model.kinds) if k == CONTROL}
        kinds = {UNKNOWN: UNKNOWN_TEXT.encode(), CONTROL: b""}
        self.decimals = [str(i) for i in range(len(model.pieces))]
        #: What each id decodes to, but for the first.
        self.surface = [bytes([model.byte_of[i]]) if i in model.byte_of else kinds.get(k, p.replace(SPACE, " ").encode()) for i, (p, k) in enumerate(zip(model.pieces, model.kinds))]

    def merged(self, text: str) -> list[str]:
        """Merging by its definition."""
        parts, score = list(text), self.model.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, before: int, token: int) -> bool:
        """Whether two tokens come out again when merged from their characters; before the first there is none (-1)."""
        a, b = self.tokens[before] if before >= 0 else "", self.tokens[token]
        if len(self.agreeing) > KEPT_PAIRS:
            self.agreeing.clear()
        found = self.agreeing[(before + 1) << 32 | token] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def cut(self, segment: str) -> list[int]:
        """The tokens of a segment of joinable characters."""
        n, length, shorter, agreeing = len(segment), self.length, self.shorter, self.agreeing
        longest = [-1] * n
        for end, k in self.automaton.iter(segment):  # by their ends, so that of one start the longest comes last
            longest[end + 1 - length[k]] = k
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []
        at, before, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not failed[end >> 3] >> (end & 7) & 1:
                    ok = agreeing.get((before + 1) << 32 | token)
                    if ok or ok is None and self.agree(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before = end, token
                token = longest[at] if at < n else -1
            else:  # no token goes on from here: never come here again
                if not out:
                    raise ValueError("no sequence of pieces is stable under merging")
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= length[last]
                before, token = out[-1] if out else -1, shorter[last]
        return out

    def _ids(self, part: str) -> Iterator[int]:
        """A piece's id, or those of its bytes."""
        found = self.model.id_of.get(part)
        if found is not None:
            yield found
        elif self.model.byte_ids:
            for byte in part.encode():
                yield self.model.byte_ids[byte]
        else:
            yield self.model.unknown

    def encoded(self, text: str) -> Iterator[tuple[tuple[int, ...], str]]:
        """Ids of each segment of a text, and the same as decimals joined by commas."""
        if not text:
            return
        kept = self.segments
        for segment in self.find((SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)):
            found = kept.get(segment)
            if found is None:
                parts = map(self.ids_of.__getitem__, self.cut(segment)) if segment[-1] in self.joinable else map(self._ids, segment)
                ids = tuple(chain.from_iterable(parts))
                found = ids, ",".join(map(self.decimals.__getitem__, ids))
                if len(segment) <= KEPT_LENGTH:
                    if len(kept) > KEPT_SEGMENTS:
                        kept.clear()
                    kept[segment] = found
            yield found

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.encoded(text) for i in ids]

    def forget(self) -> None:
        """Drops kept segments: a worker may go on to other work."""
        self.segments.clear()

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: a first space that the prefix made is dropped; bytes that aren't UTF-8 give a replacement character each."""
        kinds, pieces = self.model.kinds, self.model.pieces
        raw = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if kinds[i] != CONTROL), None)
        drop = int(first is not None and self.model.dummy_prefix and kinds[first] == NORMAL and pieces[first].startswith(SPACE))
        if self.controls.isdisjoint(ids):
            try:
                return raw[drop:].decode()
            except UnicodeDecodeError:
                pass
        return self._run_by_run(ids)[drop:]

    def _run_by_run(self, ids: Sequence[int]) -> str:
        """Decodes each run of bytes by itself: what stands between two, be it an id without text, parts characters."""
        out, run = [], bytearray()

        def end():
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                    except UnicodeDecodeError:
                        continue
                    at += size
                    break
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if i in self.model.byte_of:
                run.append(self.model.byte_of[i])
            else:
                end()
                out.append(self.surface[i].decode())
        end()
        return "".join(out)


_loaded: dict[str, PieceBpe] = {}


def loaded(path: str) -> PieceBpe:
    """One encoder for a worker."""
    if path not in _loaded:
        _loaded[path] = PieceBpe(path)
    return _loaded[path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b"")).alias("t"))


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of doc_id and text."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for at, texts in slices_of(batch.column(1), SLICE):
                ids = [bpe.encode(t.decode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.forget()

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for each row of doc_id and ids; null ids give the empty text."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            texts = [bpe.decode(ids.as_py() or ()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """For each text the number of its ids, and digests of the ids and of the text decoded from them."""

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for at, texts in slices_of(batch.column(1), SLICE):
                counts, digests, decoded = [], [], []
                for t in texts:
                    segments = list(bpe.encoded(t.decode()))
                    ids = list(chain.from_iterable(s for s, _ in segments))
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(",".join([d for _, d in segments]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_piece_round_trip(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))
