"""Language identification with a linear-chain conditional random field over words.

Words are runs of letters (any byte beyond ASCII counts as part of one), with A-Z in lower case. A
word's features are its affixes and n-grams (two to four bytes, with marks for its beginning and
end) and the word itself as a lexicon entry, all hashed into ``BUCKETS``. Weights of features and
of transitions between languages are learned from labelled texts; training sequences splice pieces
of texts in different languages, so transitions are those of code-switched text. Forward-backward
gives each word's distribution over languages; a text's language is the one with most mass.

For training, labelled texts are cut into pieces of ``PIECE_CHARS`` code points, which are rows; of those with a
letter at most ``SAMPLE`` take part, shared evenly between the languages and picked by a hash of the id and
the piece's number. So every part of every text may be picked. All texts are labelled whole.

Nulls: a null text, an empty one and one without letters are "und" with score 0; rows with a null
label train nothing; a null id counts as the empty text in the split. Without any labelled row all
are "und". Repeated rows are labelled each; ties go to the first language in order. Very long texts
are labelled whole, alone if they have more than about ``BATCH_WORDS`` words. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, give_back, slices_of, utf8
from .ragged import TimeMajor, forward_backward

BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
SAMPLE = 1000
PIECE_CHARS = 4_000
PIECE_WORDS = 40
PIECES = 3
EPOCHS = 30
#: Words of a batch of texts that forward-backward runs over at once.
BATCH_WORDS = 150_000
#: Words whose features are worked out at once.
FEATURE_WORDS = 20_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def has_letter(text: bytes, words: list[bytes]) -> bool:
    """Whether a text whose words are given has a letter; bytes beyond ASCII may be none."""
    return any(w[0] < 128 for w in words) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words, one word after the other, and where each word's begin."""
    marked = np.frombuffer(b"".join(b"\x01%b\x02" % w for w in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(marked))  # bytes from here to the end of the word
    found, owners = [], []
    rolled = marked.copy()
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()) if len(words) else 0, np.uint64(1099511628211))]))
    whole = np.add.reduceat((marked + np.uint64(1)) * powers[np.arange(len(marked)) - starts[owner]], starts) if len(words) else np.zeros(0, np.uint64)
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint64(257) + marked[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n in ORDERS:
            ok = np.flatnonzero(left[: len(rolled)] >= n)
            found.append(bucket(rolled[ok], n))
            owners.append(owner[ok])
    found.append(bucket(whole, 0))
    owners.append(np.arange(len(words)))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(owners[order], np.arange(len(words)))


def bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind * 0x1000003)) * _ODD
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    start: np.ndarray
    trans: np.ndarray

    def scores(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)), self.weights.dtype)
        out = np.empty((len(words), len(self.labels)), self.weights.dtype)
        for s in range(0, len(words), FEATURE_WORDS):
            found, starts = features(words[s : s + FEATURE_WORDS])
            out[s : s + FEATURE_WORDS] = np.add.reduceat(self.weights[found], starts, axis=0)
        return out


def posteriors(model: Crf, emission: np.ndarray, tm: TimeMajor) -> tuple[np.ndarray, np.ndarray]:
    """Distribution over labels of each token of the layout, and expected transitions."""
    potential = np.exp(emission - emission.max(1, keepdims=True)) + 1e-30
    gamma, pairs, _ = forward_backward(np.exp(model.start), np.exp(model.trans), potential, tm)
    return gamma / gamma.sum(1, keepdims=True), pairs


def spliced(texts: list[tuple[list[bytes], int]], seed: int) -> list[list[tuple[bytes, int]]]:
    """Training sequences: some pieces of different texts one after the other."""
    rng = np.random.default_rng(seed)
    pieces = []
    for words, label in texts:
        at = 0
        while at < len(words):
            n = int(rng.integers(PIECE_WORDS // 4, PIECE_WORDS * 2))
            pieces.append([(w, label) for w in words[at : at + n]])
            at += n
    order = rng.permutation(len(pieces))
    return [[x for i in order[s : s + PIECES] for x in pieces[i]] for s in range(0, len(order), PIECES)]


def train(texts: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = 7) -> Crf:
    """Weights that maximise the likelihood of the labels of spliced texts, by Adagrad over all sequences."""
    labels = sorted({label for _, label in texts})
    k = len(labels)
    model = Crf(labels, np.zeros((BUCKETS, k), np.float32), np.zeros(k, np.float32), np.zeros((k, k), np.float32))
    seqs = [s for s in spliced([(words_of(t), labels.index(y)) for t, y in texts], seed) if s]
    if not seqs:
        return model
    vocabulary: dict[bytes, int] = {}
    at = np.array([vocabulary.setdefault(w, len(vocabulary)) for s in seqs for w, _ in s])
    gold = np.array([y for s in seqs for _, y in s])
    found, starts = features(list(vocabulary))
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(starts, len(found))))
    tm = TimeMajor(np.array([len(s) for s in seqs]))
    laid, gold_laid = tm.lay(at), tm.lay(gold)
    truth = np.zeros((len(at), k), np.float32)
    truth[np.arange(len(at)), gold_laid] = 1
    inside = np.ones(len(at), bool)
    inside[np.cumsum(tm.lengths) - 1] = False
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (gold[:-1][inside[:-1]], gold[1:][inside[:-1]]), 1)
    first = len(tm.lengths)
    grown = [np.full_like(p, 1e-6) for p in (model.weights, model.start, model.trans)]
    for _ in range(epochs):
        emission = np.add.reduceat(model.weights[found], starts, axis=0)[laid]
        gamma, pairs = posteriors(model, emission, tm)
        wrong = truth - gamma
        by_word = np.stack([np.bincount(laid, weights=wrong[:, j], minlength=len(vocabulary)) for j in range(k)], axis=1)
        step = np.stack([np.bincount(found, weights=by_word[owner, j], minlength=BUCKETS) for j in range(k)], axis=1).astype(np.float32)
        for value, gradient, sums in zip((model.weights, model.start, model.trans), (step - 0.1 * model.weights, wrong[:first].sum(0), (seen_pairs - pairs).astype(np.float32)), grown, strict=True):
            sums += gradient**2
            value += 0.1 * gradient / np.sqrt(sums)
    return model


def pieces(docs: DataFrame) -> DataFrame:
    """lang, draw and text of each piece with a letter of the labelled texts. docs: doc_id, t, lang."""
    fit = docs.filter(F.col("lang").isNotNull() & (F.octet_length("t") > 0))
    cut = F.regexp_extract_all(F.col("t").cast("string"), F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0))
    rows = fit.select("lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.posexplode(cut).alias("i", "s"))
    draw = F.crc32(F.concat(F.lit("language:"), "id", F.lit(":"), F.col("i").cast("string")).cast("binary"))
    return rows.select("lang", draw.alias("draw"), "s").filter(F.col("s").rlike(r"\p{L}"))


def labelled_sample(docs: DataFrame) -> list[tuple[bytes, str]]:
    """At most SAMPLE pairs of a piece and its label, shared evenly between labels, by the hash of id and place. docs: doc_id, t, lang."""
    rows = pieces(docs)
    counts = dict(rows.groupBy("lang").count().collect())
    if not counts:
        return []
    each = max(1, SAMPLE // len(counts))
    share = F.coalesce(*(F.when(F.col("lang") == y, F.lit(min(1.0, 1.5 * each / n))) for y, n in counts.items()), F.lit(0.0))
    some = rows.filter(F.col("draw") < share * (1 << 32)).collect()  # some 1.5 x SAMPLE pieces
    kept, of = [], dict.fromkeys(counts, 0)
    for y, _, t in sorted(some):
        if of[y] < each:
            of[y] += 1
            kept.append((t.encode(), y))
    return kept


def predicted(docs: DataFrame, model: Crf, columns: list[str]) -> DataFrame:
    """The given columns with lang_pred and score. docs has column ``t``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def label_batch(model, texts):
        vocabulary: dict[bytes, int] = {}
        place = vocabulary.setdefault
        at, lengths, kept = [], [], []
        for i, text in enumerate(texts):
            words = words_of(text)
            if words and has_letter(text, words):
                at += [place(w, len(vocabulary)) for w in words]
                lengths.append(len(words))
                kept.append(i)
        labels, scores = ["und"] * len(texts), [0.0] * len(texts)
        if kept and model.labels:
            tm = TimeMajor(np.array(lengths))
            gamma, _ = posteriors(model, model.scores(list(vocabulary))[tm.lay(np.array(at))], tm)
            mass = tm.sums(gamma.astype(np.float64)) / np.array(lengths)[:, None]
            for i, m in zip(kept, mass, strict=True):
                labels[i], scores[i] = model.labels[int(m.argmax())], float(min(1.0, m.max()))
        return labels, scores

    def run(batches):
        model = shared.value
        for batch in batches:
            labels, scores = [], []
            for _, texts in slices_of(batch.column(0), 6 * BATCH_WORDS):
                more = label_batch(model, texts)
                labels += more[0]
                scores += more[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])
        give_back()

    return docs.select("t", *columns).mapInArrow(run, f"{schema}, lang_pred string, score double")


def identified(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), utf8("text").alias("t"), held_out.alias("held_out"))
    model = train(labelled_sample(docs.filter(~F.col("held_out"))))
    return predicted(docs, model, ["doc_id", "held_out"])


def op5_language_id(docs: DataFrame) -> DataFrame:
    return identified(docs, crc_of_id() % 3 == 1)
