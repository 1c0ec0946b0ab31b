"""A hidden Markov language model over the words of a corpus.

Words are runs of bytes that aren't white space, with A-Z in lower case; each text ends with one
end token. Every word belongs to a class: the most frequent words have a class of their own, the
others share classes by the hash of their last bytes. Hidden states emit classes; within a shared
class a word has the probability (c + 1) / (N + V + 1), where c is its count and N and V are the
tokens and words of the class, so that one unseen word has a share too. Thus the parameters that
Baum-Welch trains have a fixed size, while the counts of words grow with the corpus and never
leave the executors: a bounded lexicon of frequent words is broadcast, all other words are joined.

Baum-Welch: each round, every task runs scaled forward and backward recursions over the training
texts and adds up expected counts; these are summed by class and become the next parameters.
Both take whole texts. Training works on blocks of ``BLOCK`` tokens of a long text side by side; the
messages that pass between the blocks are worked out first, so that the counts are those of the
uncut text. A task holds about ``BATCH_TOKENS`` tokens at once, or one longer text.

Very long texts need memory in proportion to their length. There are no ties. An empty table gives an
empty result. Nulls: a null text is empty and has the end token alone; a null id counts as the empty text in the
split. Repeated rows are scored each. Without training rows all words are unknown and both scores
follow from the smoothing alone. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, row_ids, stored, utf8
from .ragged import TimeMajor, forward, forward_backward, messages

END = b""
STATES = 8
ROUNDS = 6
#: Words with a class of their own (with the end token), and classes shared by all others.
OWN_CLASSES = 3072
SHARED_CLASSES = 1024
#: Entries of the lexicon that is broadcast.
LEXICON = 150_000
#: Tokens of a block, of a batch, those put in order of length together, and words that a task counts before it passes them on.
BLOCK = 8192
BATCH_TOKENS = 1_000_000
SORTED_TOKENS = 8_000_000
COUNTED_WORDS = 300_000
SEED = 20_011


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def shared_class(word: bytes) -> int:
    return OWN_CLASSES + zlib.crc32(word[-3:]) % SHARED_CLASSES


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, c long) over the texts in column ``t``; the end token is the empty word."""

    def run(batches):
        found: dict[bytes, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                for w in words_of(text.as_py()):
                    found[w] = found.get(w, 0) + 1
                found[END] = found.get(END, 0) + 1
                if len(found) > COUNTED_WORDS:
                    yield rows()
                    found.clear()
        yield rows()

    return docs.select("t").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Frequent words by rank, and what is known of each shared class."""

    words: list[bytes]
    counts: np.ndarray
    n_tokens: int
    n_words: int
    class_tokens: np.ndarray
    class_words: np.ndarray

    def arrays(self):
        """For each word of the lexicon, then for each shared class: its class, log10(c + 1), and whether its word is known."""
        n = len(self.words)
        own = max(0, min(OWN_CLASSES - 1, n))
        classes = np.array([*range(1, own + 1), *(shared_class(w) for w in self.words[own:]), *range(OWN_CLASSES, OWN_CLASSES + SHARED_CLASSES)], np.int16)
        if END in self.words:
            classes[self.words.index(END)] = 0
        log_c = np.concatenate([np.log10(self.counts + 1.0), np.zeros(SHARED_CLASSES)])
        known = np.concatenate([np.ones(n, np.int64), np.zeros(SHARED_CLASSES, np.int64)])
        return classes, log_c, known

    def class_logs(self) -> np.ndarray:
        """log10(N + V + 1) of shared classes; 0 for classes of one word."""
        out = np.zeros(OWN_CLASSES + SHARED_CLASSES)
        out[OWN_CLASSES:] = np.log10(self.class_tokens[OWN_CLASSES:] + self.class_words[OWN_CLASSES:] + 1.0)
        return out


def lexicon_of(counts: DataFrame) -> Lexicon:
    """The bounded lexicon and the sums of classes; two aggregates over all words.

    The lexicon takes every word at least as frequent as the smallest count at which they are no
    more than ``LEXICON``.
    """
    totals = counts.agg(F.sum("c"), F.count("*")).first()
    n_tokens, n_words = totals[0] or 0, totals[1]
    by_count = np.array(sorted(((r[0], r[1]) for r in counts.groupBy("c").count().collect()), reverse=True), np.int64).reshape(-1, 2)
    kept = by_count[np.cumsum(by_count[:, 1]) <= LEXICON]
    least = int(kept[-1, 0]) if len(kept) else None
    head = [] if least is None else counts.filter((F.col("c") >= least) & (F.col("word") != F.lit(END))).collect()
    ranked = sorted(((-r[1], bytes(r[0])) for r in head))
    ends = counts.filter(F.col("word") == F.lit(END)).collect()
    words, freq = [END], [ends[0][1] if ends else 0]
    for c, w in ranked:
        words.append(w)
        freq.append(-c)
    own = set(words[: OWN_CLASSES - 1])  # as in arrays()

    def run(batches):
        tokens, types = np.zeros(OWN_CLASSES + SHARED_CLASSES, np.int64), np.zeros(OWN_CLASSES + SHARED_CLASSES, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            at = np.array([0 if w in own else shared_class(w) for w in words], np.int64)
            np.add.at(tokens, at, batch.column(1).to_numpy())
            np.add.at(types, at, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens), dtype=np.int32)), pa.array(tokens), pa.array(types)], ["k", "n", "v"])

    sums = counts.select("word", "c").mapInArrow(run, "k int, n long, v long").filter(F.col("k") >= OWN_CLASSES).groupBy("k").agg(F.sum("n"), F.sum("v")).collect()
    class_tokens, class_words = np.zeros(OWN_CLASSES + SHARED_CLASSES, np.int64), np.zeros(OWN_CLASSES + SHARED_CLASSES, np.int64)
    for k, n, v in sums:
        class_tokens[k], class_words[k] = n, v
    return Lexicon(words, np.array(freq, np.int64), n_tokens, n_words, class_tokens, class_words)


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, log_c double, class_log_c double, class_log double, codes binary, rare array<binary>"


def encoded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row for each text: its classes, sums over the words of the lexicon, and all other words."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.words, *lexicon.arrays(), lexicon.class_logs()))

    class Places(dict):
        def __missing__(self, word):
            self.rare.append(word)
            return self.base + zlib.crc32(word[-3:]) % SHARED_CLASSES

    def run(batches):
        words, classes, log_c, known, class_logs = shared.value
        places = Places(zip(words, range(len(words)), strict=True))
        places.base = len(words)
        ids = row_ids()
        end = [places[END]]
        for batch in batches:
            out = {k: [] for k in ("n_known", "log_c", "class_log_c", "class_log", "codes", "rare", "n_tokens")}
            for text in batch.column(2):
                places.rare = []
                tokens = words_of(text.as_py())
                at = np.fromiter(map(places.__getitem__, tokens), np.int32, len(tokens))
                at = np.concatenate([at, np.array(end, np.int32)])
                codes = classes[at]
                logs = log_c[at]
                out["n_tokens"].append(len(at))
                out["n_known"].append(int(known[at].sum()))
                out["log_c"].append(float(logs.sum()))
                out["class_log_c"].append(float(logs[codes >= OWN_CLASSES].sum()))
                out["class_log"].append(float(class_logs[codes].sum()))
                out["codes"].append(codes.tobytes())
                out["rare"].append(places.rare)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(ids) for _ in range(n)], pa.int64()), batch.column(0), batch.column(1), *(pa.array(out[k], t) for k, t in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_c", pa.float64()), ("class_log_c", pa.float64()), ("class_log", pa.float64()), ("codes", pa.binary()), ("rare", pa.list_(pa.binary()))))],
                [x.split()[0] for x in ENCODED.split(", ")],
            )

    return docs.select("doc_id", "held_out", "t").mapInArrow(run, ENCODED)


@dataclass
class Hmm:
    first: np.ndarray
    trans: np.ndarray
    emit: np.ndarray  # a row for each class, a column for each state


def start(class_counts: np.ndarray) -> Hmm:
    """States that lean apart from the class frequencies by seeded noise."""
    rng = np.random.default_rng(SEED)
    base = (class_counts + 1.0) / (class_counts + 1.0).sum()
    emit = base[:, None] * np.exp(rng.normal(0, 0.5, (len(base), STATES)))
    trans = np.full((STATES, STATES), 0.05 / (STATES - 1))
    np.fill_diagonal(trans, 0.95)
    return Hmm(np.full(STATES, 1 / STATES), trans, emit / emit.sum(0))


def by_length(codes, most: int):
    """Sequences of about ``most`` tokens at a time, short ones first: a recursion takes as many steps as a batch's longest has tokens."""
    held, total = [], 0
    for c in codes:
        held.append(c)
        total += len(c)
        if total >= most:
            yield from sorted(held, key=len)
            held, total = [], 0
    yield from sorted(held, key=len)


def batches_of(codes, most: int):
    """Batches of whole sequences, each of about ``most`` tokens or one longer sequence."""
    batch, total = [], 0
    for c in codes:
        batch.append(c)
        total += len(c)
        if total >= most:
            yield batch
            batch, total = [], 0
    if batch:
        yield batch


def expected_counts(seqs: list[np.ndarray], model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected first states, transitions and emissions of whole sequences. Long ones are worked on in blocks that exchange their messages."""
    parts = [c[i : i + BLOCK] for c in seqs for i in range(0, len(c), BLOCK)]
    number = np.array([-(-len(c) // BLOCK) for c in seqs])
    goes_on = np.ones(len(parts), bool)
    goes_on[np.cumsum(number) - 1] = False
    begins = np.concatenate([[True], ~goes_on[:-1]])
    first, trans, emit = (x.astype(np.float32) for x in (model.first, model.trans, model.emit))
    tm = TimeMajor(np.array([len(s) for s in parts]))
    laid = tm.lay(np.concatenate(parts))
    if goes_on.any():
        into, back = messages(first, trans, emit, parts, goes_on)
        gamma, pairs, _ = forward_backward(into.astype(np.float32), trans, emit[laid], tm, back, goes_on)
    else:
        gamma, pairs, _ = forward_backward(first, trans, emit[laid], tm)
    emitted = np.stack([np.bincount(laid, weights=gamma[:, k], minlength=len(model.emit)) for k in range(STATES)], axis=1)
    return gamma[tm.place[tm.starts[begins]]].sum(0, dtype=np.float64), pairs, emitted


def improved(training: DataFrame, model: Hmm) -> Hmm:
    """One round of Baum-Welch over all training texts. Rows -1 and below hold the first states and the transitions."""
    shared = training.sparkSession.sparkContext.broadcast(model)
    n = len(model.emit)

    def run(batches):
        now = shared.value
        first, pairs, emitted = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((n, STATES))

        def texts():
            for batch in batches:
                for c in batch.column(0):
                    yield np.frombuffer(c.as_py(), np.int16)

        for seqs in batches_of(by_length(texts(), SORTED_TOKENS), BATCH_TOKENS):
            a, b, c = expected_counts(seqs, now)
            first += a
            pairs += b
            emitted += c
        used = np.flatnonzero(emitted.sum(1))
        at = np.concatenate([[-1], np.arange(-2, -2 - STATES, -1), used]).astype(np.int32)
        rows = np.concatenate([first[None], pairs, emitted[used]])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(STATES))], ["k", *(f"s{k}" for k in range(STATES))])

    sums = training.select("codes").mapInArrow(run, "k int, " + ", ".join(f"s{k} double" for k in range(STATES))).groupBy("k").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(STATES))).toArrow()
    shared.unpersist()
    at = sums["k"].to_numpy()
    rows = np.stack([sums[f"s{k}"].to_numpy() for k in range(STATES)], axis=1)
    order = np.argsort(at)  # sums of doubles come in any order; rows don't
    at, rows = at[order], rows[order]
    first, pairs, emitted = np.ones(STATES), np.ones((STATES, STATES)), np.zeros((n, STATES))
    first += rows[at == -1].sum(0)
    for k in range(STATES):
        pairs[k] += rows[at == -2 - k].sum(0)
    emitted[at[at >= 0]] = rows[at >= 0]
    base = emitted.sum(1) + 1.0
    emitted += STATES * base[:, None] / base.sum() * 10  # a little of the mixture in each state
    return Hmm(first / first.sum(), pairs / pairs.sum(1, keepdims=True), emitted / emitted.sum(0))


def sequence_scores(codes: list[np.ndarray], model: Hmm) -> np.ndarray:
    """log10 likelihood of each whole sequence of classes by scaled forward recursion."""
    out = [np.zeros(0)]
    for batch in batches_of(codes, BATCH_TOKENS):
        tm = TimeMajor(np.array([len(c) for c in batch]))
        _, scale = forward(model.first, model.trans, model.emit[tm.lay(np.concatenate(batch))], tm)
        out.append(tm.sums(np.log10(scale)))
    return np.concatenate(out)


def trained(training: DataFrame, rounds: int = ROUNDS) -> Hmm:
    """The model after some rounds over the column ``codes``."""
    n = OWN_CLASSES + SHARED_CLASSES

    def count(batches):
        found = np.zeros(n, np.int64)
        for batch in batches:
            for c in batch.column(0):
                found += np.bincount(np.frombuffer(c.as_py(), np.int16), minlength=n)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["k", "n"])

    counts = np.zeros(n)
    for k, c in training.select("codes").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        counts[k] = c
    model = start(counts)
    for _ in range(rounds):
        model = improved(training, model)
    return model


def score_texts(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """Scores of all texts by a model of those that aren't held out.

    docs: doc_id and text. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigram) and score (hidden Markov model), log10 probabilities of whole texts.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), utf8("text").alias("t"))
    counts = stored(word_counts(docs.filter(~F.col("held_out"))), "hmm-counts")
    lexicon = lexicon_of(counts)
    texts = stored(encoded(docs, lexicon), "hmm-texts")
    model = trained(texts.filter(~F.col("held_out")))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = sequence_scores([np.frombuffer(c.as_py(), np.int16) for c in batch.column(0)], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "sequence"])

    names = [x.split()[0] for x in ENCODED.split(", ") if x.split()[0] not in ("codes", "rare")]
    whole = texts.select("codes", *names).mapInArrow(run, ", ".join(x for x in ENCODED.split(", ") if x.split()[0] in names) + ", sequence double")
    rare = texts.select("rid", F.explode("rare").alias("word")).join(counts, "word").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("more_known"))
    more = F.coalesce(F.col("more"), F.lit(0.0))
    return whole.join(rare, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.col("more_known"), F.lit(0))).alias("n_known"),
        F.lit(lexicon.n_tokens).cast("long").alias("train_tokens"),
        (F.col("log_c") + more - F.col("n_tokens") * F.lit(math.log10(lexicon.n_tokens + lexicon.n_words + 1))).alias("base_score"),
        (F.col("sequence") + F.col("class_log_c") + more - F.col("class_log")).alias("score"),
    )


def op2_hmm_scores(docs: DataFrame) -> DataFrame:
    return score_texts(docs, crc_of_id() % 7 == 2)
