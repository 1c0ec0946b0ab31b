"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A sequence of tokens is what BPE gives for its bytes exactly if each neighbouring pair
is what BPE gives for the bytes of the pair, so each prefix of the bytes has one last token only.
The merges thus compile into a transducer that reads bytes: one hypothesis for each place where the
token under way may have begun, as the trie node of the bytes since and the token before. A
determinised state is the list of live hypotheses; its output is the last token of the prefix read.
States and arcs are made when first needed and kept; when there are very many, all are dropped and
made anew. Tokens are given out once all live hypotheses agree on them, and never taken back; as no
hypothesis is longer than the longest token, no token waits for more than a bounded lookahead.

Texts are cut into pieces by the splitting pattern; the tokens of short pieces are kept, so that the
transducer reads few of them twice.

Decoding. Ids become bytes; an incremental UTF-8 machine keeps the bytes of an unended character
between chunks and gives a replacement character for what can't be UTF-8.

Nulls: a null text is empty: no tokens; a null doc_id is passed on. Empty texts have no tokens and
the digests of nothing. Repeated rows are encoded each. Very long texts are taken whole, piece by
piece. An empty table gives an empty result. There are no ties: an encoding is unique. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the tokenizer library has it (Python's own class has four control characters more).
SPACE = r"\t-\r \x85\xa0  -     　"
# Letters and numbers of Unicode versions after 16, the library's; there they are neither.
LATER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: A character that is neither letter, number nor white space in any version.
OTHER = "\ue000"
#: States of the transducer, pairs of tokens, and pieces of text with their tokens, that a worker keeps; longer ones aren't kept.
KEPT_STATES = 250_000
KEPT_PAIRS = 400_000
KEPT_PIECES = 400_000
KEPT_LENGTH = 40
#: Bytes after which the tokens of a piece that are sure are given out.
WINDOW = 4096
#: Ids that are decoded at once.
DECODED = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pattern_of(source: str):
    """A splitting pattern with the library's white space class."""
    import regex

    return regex.compile(source.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def later_characters():
    """Finds characters of LATER."""
    spans = [[chr(int(x, 16)) for x in span.split("-")] for span in LATER.split()]
    return re.compile("[" + "".join("-".join(map(re.escape, span)) for span in spans) + "]")


def merge_pairs(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """BPE by its definition: again and again the leftmost pair of least rank becomes one token, while there are more than ``least``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > least:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


_BEFORE = (1 << 24) - 1


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        #: The trie of all tokens: (node, byte) to node; for each node its depth, the token that ends there or -1, and whether it goes on.
        self.child: dict[int, int] = {}
        self.depth, self.token_at, self.goes_on = [0], [-1], bytearray(1)
        for t, r in ranks.items():
            node = 0
            for i, byte in enumerate(t, 1):
                self.goes_on[node] = 1
                node = self.child.setdefault(node << 8 | byte, len(self.depth))
                if node == len(self.depth):
                    self.depth.append(i)
                    self.token_at.append(-1)
                    self.goes_on.append(0)
            self.token_at[node] = r
        self.reachable: dict[int, bool] = {}
        self.agreeing: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.forget()

    def forget(self) -> None:
        """Drops all states and arcs but the start, which is state 0."""
        #: Hypotheses of a state, each a trie node and the token before (one more; 0 at the start), oldest first.
        self.live: list[tuple[int, ...]] = [(0,)]
        self.state_of: dict[tuple[int, ...], int] = {}
        #: The last token of what a state has read, and its length.
        self.token, self.length = [-1], [0]
        self.arcs: dict[int, int] = {}

    def edge(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """The tokens at one edge of a token through its merges, outermost first: bytes, and the rank at which each merges into the one before."""
        found = self.edges[right].get(token)
        if found is None:
            piece = self.bytes_of[token]
            found, until = [(piece, float("inf"))], token
            while len(piece) > 1:
                piece = merge_pairs(piece, self.ranks, 2)[-1 if right else 0]
                found.append((piece, until))
                until = self.ranks[piece]
            self.edges[right][token] = found
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b can follow a (-1: the start): BPE makes b of its bytes, and no token at the end of a merges with one at the start of b while both are there."""
        found = self.whole(b)
        if found and a >= 0:
            ranks, starts = self.ranks, self.edge(b, False)
            for x, x_until in self.edge(a, True):
                for y, y_until in starts:
                    m = ranks.get(x + y)
                    if m is not None and m < x_until and m <= y_until:
                        found = False
                        break
                if not found:
                    break
        if len(self.agreeing) > KEPT_PAIRS:
            self.agreeing.clear()
        self.agreeing[(a + 1) << 32 | b] = found
        return found

    def whole(self, b: int) -> bool:
        """Whether b is what BPE gives for its own bytes."""
        found = self.reachable.get(b)
        if found is None:
            found = self.reachable[b] = len(merge_pairs(self.bytes_of[b], self.ranks)) == 1
        return found

    def arc(self, state: int, byte: int) -> int:
        """Makes the arc of a state for a byte: each hypothesis reads the byte, and the one whose token ends there begins a new one."""
        child, token_at, goes_on, agreeing = self.child, self.token_at, self.goes_on, self.agreeing
        live, ended = [], -1
        for hypothesis in self.live[state]:
            node = child.get((hypothesis >> 24) << 8 | byte)
            if node is None:
                continue
            before = hypothesis & _BEFORE
            if ended < 0:
                token = token_at[node]
                if token >= 0:
                    ok = agreeing.get(before << 32 | token)
                    if ok or ok is None and self.may_follow(before - 1, token):
                        ended = token
            if goes_on[node]:
                live.append(node << 24 | before)
        if ended < 0:
            raise ValueError(f"no token ends at byte {byte}")
        live.append(ended + 1)
        key = tuple(live)
        to = self.state_of.get(key)
        if to is None:
            to = self.state_of[key] = len(self.live)
            self.live.append(key)
            self.token.append(ended)
            self.length.append(len(self.bytes_of[ended]))
        self.arcs[state << 8 | byte] = to
        return to

    def sure(self, state: int, ends: list[int], base: int) -> int:
        """How far all live hypotheses agree on the tokens. ends: a state for each byte after place ``base``, up to which they agree."""
        places = {len(ends) + base - self.depth[h >> 24] for h in self.live[state]}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(max(base, last - self.length[ends[last - base - 1]]))
        return places.pop()

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one piece of text. A piece that is itself a token is that token."""
        direct = self.ranks.get(piece)
        if direct is not None:
            return (direct,)
        if len(self.live) > KEPT_STATES:
            self.forget()
        arcs, out, base = self.arcs, [], 0
        state, ends = 0, []
        for i in range(0, len(piece), WINDOW):
            for byte in piece[i : i + WINDOW]:
                to = arcs.get(state << 8 | byte)
                state = self.arc(state, byte) if to is None else to
                ends.append(state)
            last = i + WINDOW >= len(piece)
            at = until = len(piece) if last else self.sure(state, ends, base)
            given = []
            while at > base:
                end = ends[at - base - 1]
                given.append(self.token[end])
                at -= self.length[end]
            out += reversed(given)
            del ends[: until - base]
            base = until
        return tuple(out)


class Utf8Stream:
    """An incremental UTF-8 machine: characters of the bytes so far; an unended character waits for its bytes."""

    def __init__(self):
        self.waiting = b""

    def feed(self, chunk: bytes) -> str:
        data = self.waiting + chunk
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:  # a first byte: of how many?
                need = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                if back < need and b"\xc2" <= data[-back : len(data) - back + 1] <= b"\xf4" and self._may_go_on(data[-back:]):
                    cut = len(data) - back
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _may_go_on(part: bytes) -> bool:
        if len(part) < 2:
            return True
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(part[0], 0x80)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(part[0], 0xBF)
        return low <= part[1] <= high

    def end(self) -> str:
        out, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return out


class ByteBpe:
    """Encodes texts and decodes ids with the ranks of a file."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.find = pattern_of(pattern).findall
        self.later = later_characters()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.decimals = {i: str(i) for i in self.transducer.bytes_of}

    def encode(self, text: str) -> list[int]:
        kept, out = self.pieces, []
        found = self.find(text)
        if not text.isascii() and self.later.search(text):
            ends = list(accumulate(map(len, self.find(self.later.sub(OTHER, text)))))
            found = [text[i:j] for i, j in zip([0, *ends], ends)]
        for piece in found:
            ids = kept.get(piece)
            if ids is None:
                ids = self.transducer.encode(piece.encode())
                if len(piece) <= KEPT_LENGTH:
                    if len(kept) > KEPT_PIECES:
                        kept.clear()
                    kept[piece] = ids
            out += ids
        return out

    def forget(self) -> None:
        """Drops kept pieces: a worker may go on to other work."""
        self.pieces.clear()

    def decode_stream(self, ids: Sequence[int]) -> Iterator[str]:
        """The text of the ids, given out as soon as characters are whole."""
        machine, bytes_of = Utf8Stream(), self.transducer.bytes_of.__getitem__
        for i in range(0, len(ids), DECODED):
            if text := machine.feed(b"".join(map(bytes_of, ids[i : i + DECODED]))):
                yield text
        if text := machine.end():
            yield text


_loaded: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder for a worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of doc_id and text."""

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) for each row of doc_id and ids; null ids give the empty text."""

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            texts = ["".join(bpe.decode_stream(ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each text the number of its tokens, and digests of its ids and of the bytes decoded from them."""

    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(bpe.decimals.__getitem__, ids)).encode()).hexdigest())
                digest = hashlib.sha256()
                for text in bpe.decode_stream(ids):
                    digest.update(text.encode())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_round_trip(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
