"""Exact join of texts by the Jaccard similarity of their word n-grams, with PartEnum signatures.

A text's set holds the 64-bit hashes of its distinct shingles. Texts with equal sets are one node,
named by a hash of the set, so copies are never paired. Sizes fall into bands; two sets that are
similar enough share a band of the larger, as a set also joins the next band if it can have a
partner there. In a band at most k elements are in one set only. The domain is dealt into
partitions of two halves each; an element that is in one set only spoils one half, so of H halves
at least H - k are equal in both sets. Each half gives a signature.

Signatures that unlike sets would share aren't needed by most sets, because H is greater than k + 1
by a margin (``bins_of``): a set with e empty halves has ``slack`` = H - k - 1 - e. While that isn't
negative, one of its filled halves is equal in any similar set, and it gives out none of the empty
ones. So any similar set shares more than ``slack`` of its signatures, and each set leaves its ``slack``
most frequent ones, in an order that is the same for all: the rarest signature that two similar sets share
is left by neither.

Equal sets are merged before any signature is made: nodes that several texts have are told by a filter, and
one text of each is kept. Signatures are counted by partial sums, and only nodes that hold a shared one
meet; a signature that very many nodes hold is never gathered in one task.

Nodes that share a signature are compared as follows, so that no link between different texts is
lost and no large group is paired in full. Groups of at most ``SMALL`` nodes give their pairs. In larger
ones each node is paired with the smallest; linked nodes form components; only signatures whose
nodes are in different components go on. Their nodes are compared by odd sketches (for each bin
whether it holds an odd number of elements), which differ in no more places than the sets do, block
against block in place; in the first rounds each component's nearest pair goes on, in the last all
that the sketches don't rule out and that are still in different components. A signature without a pair
that they don't rule out is done with. Pairs are screened by
their sketches and then compared by their whole sets. Large groups are cut into blocks that go to
different tasks.

Nulls: a null text, or one without words, has an empty set and is linked with nothing; a null
doc_id is answered with the smallest other id of its component, or null. Repeated rows are copies.
Very long texts are taken whole, each in a slice of its own. An empty table gives an empty result.
Of ties there are none: a component's id is its smallest. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap_has, bitmap_of, forget, give_back, slices_of, stored
from .components import components

SHINGLE = 4
#: Sets link when PERCENT * |union| <= 100 * |intersection|.
PERCENT = 85
#: Ratio of the sizes at the ends of a band.
BAND = 1.5
#: The share of filled halves beyond k + 1 that the smallest sets of a band have on average.
MARGIN = 0.05
#: Nodes of a group whose pairs are all compared.
SMALL = 8
#: The least and greatest number of bins of a sketch; between them, as many as elements, rounded up to a power of two.
LEAST_BINS, MOST_BINS = 2048, 1 << 17
#: Nodes of a block in which all are compared by sketches.
BLOCK = 1024
#: Bytes of texts that are worked on at once.
SLICE = 2_000_000
#: Bits of the filters of nodes that several texts have and of signatures that several nodes have, as powers of two.
COPIED_BITS, SHARED_BITS = 24, 26

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IN_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and how many words each text has. A word is taken eight bytes at a time."""
    raw = np.frombuffer(b" ".join([*texts, b" " * 8]), np.uint8)
    low, inside = _LOWER[raw], _IN_WORD[raw]
    turns = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    h = mixed((eight[starts] & _MASK[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _ODD[2])
    more, at = np.flatnonzero(lengths > 8), 8
    while len(more):
        h[more] = mixed(h[more] * _ODD[3] + (eight[starts[more] + at] & _MASK[np.minimum(lengths[more] - at, 8)]))
        at += 8
        more = more[lengths[more] > at]
    return h, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of n words; of a shorter text, one of all its words."""
    h, counts = word_hashes(texts)
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        total += h[i : i + len(total)] * _ODD[i % len(_ODD)]
    total = mixed(total)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            found = np.sort(total[at : at + c - n + 1])
            fresh = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            out.append(found[fresh])
        elif c:
            weighed = h[at : at + c] * np.array(_ODD, np.uint64)[np.arange(c) % len(_ODD)]
            out.append(mixed(weighed.sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def name_of(found: np.ndarray) -> int:
    """A set's node: a signed 64-bit hash of all its elements."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


@lru_cache(maxsize=4)
def band_edges(above: int) -> np.ndarray:
    """Smallest sizes of the bands, up to one above the given size."""
    edges, x = [1], 1.0
    while edges[-1] <= above * BAND * BAND:
        x *= BAND
        edges.append(max(edges[-1] + 1, int(x)))
    return np.array(edges, np.int64)


def most_different(largest: int, percent: int = PERCENT) -> int:
    """How many elements may be in one only of two similar sets of at most this size."""
    return 2 * largest * (100 - percent) // (100 + percent)


@lru_cache(maxsize=1000)
def bins_of(least: int, k: int) -> int:
    """Halves of a band whose smallest members have ``least`` elements: so many that these fill more than k + 1 on average, if that can be."""
    n1 = k // 2 + 1
    while n1 < 2 * (k + 1) and 2 * n1 * -np.expm1(-least / (2 * n1)) < (1 + MARGIN) * (k + 1) + 1:
        n1 += 1 + n1 // 50
    return 2 * n1


def signatures(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """PartEnum signatures of sets, for the band of each and, if it can have a partner there, the next.

    Gives the signatures, the place of each one's set, and each set's slack in bands of even and odd
    number (-1 where it has none). A signature's last bit tells its band's.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    slack = np.full((len(sets), 2), -1, np.int32)
    edges = band_edges(1 << int(sizes.max(initial=1)).bit_length())
    own = np.searchsorted(edges, sizes, side="right") - 1
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for further in (0, 1):
        bands = own + further
        jobs = np.flatnonzero((sizes > 0) & ((further == 0) | (100 * sizes >= percent * edges[bands])))
        known = {b: (k := most_different(int(edges[b + 1]) - 1, percent), bins_of(-(-percent * int(edges[b]) // 100), k) if k else 0) for b in set(bands[jobs].tolist())}
        jobs = jobs[[known[b][0] > 0 for b in bands[jobs].tolist()]] if len(jobs) else jobs  # k = 0: only equal sets are similar
        if not len(jobs):
            continue
        band, n = bands[jobs], sizes[jobs]
        k, bins = np.array([known[b] for b in band.tolist()], np.int64).T
        base = np.cumsum(bins) - bins
        salt = band.astype(np.uint64)
        h = mixed(np.concatenate([sets[i] for i in jobs]) + np.repeat(salt * _ODD[4], n))
        half = (((h >> np.uint64(33)) * np.repeat(bins.astype(np.uint64), n)) >> np.uint64(31)).astype(np.int64) + np.repeat(base, n)
        sums = np.zeros(int(bins.sum()), np.uint64)
        np.add.at(sums, half, mixed(h ^ _ODD[5]))
        filled = np.zeros(len(sums), bool)
        filled[half] = True
        number = (np.arange(len(sums)) - np.repeat(base, bins)).astype(np.uint64)
        left = bins - k - 1 - np.add.reduceat(~filled, base, dtype=np.int64)
        slack[jobs, band & 1] = np.maximum(left, -1)
        given = filled | np.repeat(left < 0, bins)
        key = mixed(sums ^ mixed(number * _ODD[1] + np.repeat((salt + np.uint64(1)) * _ODD[2], bins)))
        keys.append((key & ~np.uint64(1) | np.repeat(salt & np.uint64(1), bins))[given])
        owners.append(np.repeat(jobs, bins)[given])
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), slack


def sketch_of(found: np.ndarray) -> np.ndarray:
    """A bit for each bin, whether the number of its elements is odd, as longs."""
    bins = min(MOST_BINS, max(LEAST_BINS, 1 << (len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(sketch: np.ndarray, n: int) -> np.ndarray:
    """A sketch as it would be with fewer bins (n longs, a power of two)."""
    while len(sketch) > n:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def most_apart(p, q, percent: int):
    """How many elements of similar sets of sizes p and q may be in one only."""
    return (100 - percent) * (p + q) // (100 + percent)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, node (null: no words), size and slacks of each text."""

    def run(batches):
        for batch in batches:
            for at, texts in slices_of(batch.column(1), SLICE):
                sets = shingle_sets(texts, n)
                slack = signatures(sets, percent)[2]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array([name_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(slack[:, 0]), pa.array(slack[:, 1])], ["doc_id", "node", "n", "slack_0", "slack_1"]
                )
        give_back()

    return docs.mapInArrow(run, "doc_id long, node long, n long, slack_0 int, slack_1 int")


def copied_once(docs: DataFrame, texts: DataFrame, n: int) -> tuple[DataFrame, bytes]:
    """node and text of each node that several texts have, once, and a filter that all of these nodes pass.

    A node that passes by chance is among them too, so the other texts' nodes each have one text only.
    """
    copied = texts.filter("node IS NOT NULL").groupBy("node").count().filter("count > 1")
    bitmap = bitmap_of(copied, "node", COPIED_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            for _, texts in slices_of(batch.column(0), SLICE):
                found = {name_of(s): t for s, t in zip(shingle_sets(texts, n), texts) if len(s)}
                names = np.fromiter(found, np.int64, len(found))
                of = list(found.values())
                kept = np.flatnonzero(bitmap_has(shared.value, names)) if len(names) else []
                yield pa.RecordBatch.from_arrays([pa.array(names[kept], pa.int64()), pa.array([of[i] for i in kept], pa.binary())], ["node", "t"])
        give_back()

    return stored(docs.select("t").mapInArrow(run, "node long, t binary").dropDuplicates(["node"]), "jaccard-copied"), bitmap


def of_nodes(docs: DataFrame, once: DataFrame, copied: bytes, n: int, work, schema: str) -> DataFrame:
    """What ``work`` makes of the sets and names of some nodes at a time, each node once. It gives record batches."""
    shared = docs.sparkSession.sparkContext.broadcast(copied)

    def over(all_of: bool):
        def run(batches):
            for batch in batches:
                for _, texts in slices_of(batch.column(0), SLICE):
                    sets = [s for s in shingle_sets(texts, n) if len(s)]
                    names = np.array([name_of(s) for s in sets], np.int64)
                    if not all_of and len(names):
                        kept = np.flatnonzero(~bitmap_has(shared.value, names))
                        sets, names = [sets[i] for i in kept], names[kept]
                    if len(names):
                        yield work(sets, names)
            give_back()

        return run

    return docs.select("t").mapInArrow(over(False), schema).unionByName(once.select("t").mapInArrow(over(True), schema))


def shared_signatures(docs: DataFrame, once: DataFrame, copied: bytes, n: int, percent: int) -> DataFrame:
    """sig, node and of_sig (how many nodes have it) for each signature that several nodes have."""

    def count(sets, _):
        keys = np.unique(signatures(sets, percent)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys[0]), pa.array(keys[1])], ["sig", "some"])

    counted = of_nodes(docs, once, copied, n, count, "sig long, some long").groupBy("sig").agg(F.sum("some").alias("of_sig")).filter("of_sig > 1")
    counted = stored(counted, "jaccard-counted")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(counted, "sig", SHARED_BITS))

    def sign(sets, names):
        keys, owners, _ = signatures(sets, percent)
        kept = bitmap_has(shared.value, keys)
        return pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(names[owners[kept]])], ["sig", "node"])

    met = stored(of_nodes(docs, once, copied, n, sign, "sig long, node long").join(counted.hint("merge"), "sig"), "jaccard-met")
    forget(counted)
    return met


def sets_of(docs: DataFrame, once: DataFrame, copied: bytes, wanted: DataFrame, n: int) -> DataFrame:
    """node, size, sketch and members of each wanted node."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted, "node"))

    def run(sets, names):
        kept = np.flatnonzero(bitmap_has(shared.value, names))
        rows = [sets[i] for i in kept]
        return pa.RecordBatch.from_arrays([pa.array(names[kept], pa.int64()), pa.array([len(s) for s in rows], pa.int64()), pa.array([sketch_of(s) for s in rows], pa.list_(pa.int64())), pa.array([s.view(np.int64) for s in rows], pa.list_(pa.int64()))], ["node", "size", "sketch", "members"])

    found = of_nodes(docs, once, copied, n, run, "node long, size long, sketch array<long>, members array<long>")
    return found.join(wanted, "node", "left_semi")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar, stored; only pairs that their sketches don't rule out meet with their sets."""
    screened = stored(near_by_sketch(pairs, sets, percent), "jaccard-screened")
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("p"), F.col("members").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("q"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = screened.join(left, "a").join(right, "b").select("a", "b", (F.col("p") + F.col("q")).alias("s"), both.alias("both"))
    found = stored(met.filter(100 * F.col("both") >= percent * (F.col("s") - F.col("both"))).select("a", "b"), "jaccard-links")
    forget(screened)
    return found


def near_by_sketch(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose sizes or sketches show that they differ too much. Sketches of similar sets have equal lengths, or one is twice as long."""
    left = sets.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("size").alias("p"))
    right = sets.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("size").alias("q"))
    fold = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (u, v) -> u ^ v), {0})"
    apart = f"aggregate(zip_with({fold.format('x', 'y')}, {fold.format('y', 'x')}, (u, v) -> u ^ v), 0, (n, w) -> n + bit_count(w))"
    sized = (100 * F.least("p", "q") >= percent * F.greatest("p", "q")) & (F.greatest(F.size("x"), F.size("y")) <= 2 * F.least(F.size("x"), F.size("y")))
    bound = F.expr(f"{100 - percent} * (p + q) div {100 + percent}")
    return pairs.join(left, "a").join(right, "b").filter(sized).filter(F.expr(apart) <= bound).select("a", "b")


def apart_but_near(groups: DataFrame, percent: int, nearest_only: bool) -> DataFrame:
    """Pairs (sig, a, b) of nodes of one signature in different components that their sketches don't rule out.

    nearest_only: for each component, in each block of each signature, only its nearest pair.
    groups: sig, node, label, of_sig, sketch, size. A group of several blocks goes out as pairs of
    blocks, each to its own key.
    """
    blocks = F.ceil(F.col("of_sig") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    spread = groups.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "sketch", "size")

    def near(own, node, label, sketches, size):
        """Of one key: nodes of block i against those of block j, or within the block if they are the same: distances, nodes and labels."""
        n = min(map(len, sketches))
        bits = np.stack([folded(x, n) for x in sketches]).view(np.uint64)
        left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        for s in range(0, len(left), 64):
            a = left[s : s + 64]
            far = np.zeros((len(a), len(right)), np.int64)
            for x in range(0, bits.shape[1], 32):
                far += np.bitwise_count(bits[a][:, None, x : x + 32] ^ bits[right][None, :, x : x + 32]).sum(2, dtype=np.int64)
            p, q = np.nonzero((far <= most_apart(size[a][:, None], size[right][None, :], percent)) & (label[a][:, None] != label[right][None, :]))
            for d, u, v in zip(far[p, q].tolist(), a[p].tolist(), right[q].tolist(), strict=True):
                yield d, node[u], node[v], label[u], label[v]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def made(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))], ["sig", "a", "b"])

        def flush(table):
            sig, i, j = (table.column(c).to_numpy() for c in ("sig", "i", "j"))
            own, node, label, size = (table.column(c).to_numpy() for c in ("own", "node", "label", "size"))
            lists = table.column("sketch").combine_chunks()
            ends, bits = lists.offsets.to_numpy(), lists.values.to_numpy()
            sketches = [bits[a:b] for a, b in zip(ends, ends[1:])]
            cut = np.flatnonzero((np.diff(sig) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            found = set()
            for s, e in zip([0, *cut], [*cut, len(sig)], strict=True):
                if i[s] != j[s] and (own[s:e] == own[s]).all():
                    continue  # only one of the two blocks has nodes
                if (label[s:e] == label[s]).all():
                    continue
                best = {}
                for d, u, v, x, y in near(own[s:e], node[s:e], label[s:e], sketches[s:e], size[s:e]):
                    pair = (sig[s], min(u, v), max(u, v))
                    if not nearest_only:
                        found.add(pair)
                    else:
                        for of in (x, y):
                            if of not in best or (d, pair) < best[of]:
                                best[of] = (d, pair)
                found.update(pair for _, pair in best.values())
                if len(found) > 100_000:
                    yield made(found)
                    found = set()
            yield made(found)

        for batch in batches:  # sorted by key; the last key may go on in the next batch
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = [whole.column(c).to_numpy() for c in ("sig", "i", "j")]
            last = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in keys]))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield from flush(whole.slice(0, end))
            held = whole.slice(end).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    ready = keyed.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return ready.mapInArrow(run, "sig long, a long, b long").distinct()


def groups_of(met: DataFrame, texts: DataFrame) -> DataFrame:
    """met without each node's ``slack`` most frequent signatures of a band, and with the counts of what is left."""
    slack = texts.filter("node IS NOT NULL").groupBy("node").agg(F.first("slack_0").alias("slack_0"), F.first("slack_1").alias("slack_1"))
    placed = met.withColumn("odd", F.col("sig").bitwiseAND(F.lit(1))).join(slack.hint("merge"), "node")
    frequent = Window.partitionBy("node", "odd").orderBy(F.desc("of_sig"), "sig")  # as many rows as a set has signatures
    left = placed.withColumn("r", F.row_number().over(frequent)).filter("r > if(odd = 1, slack_1, slack_0)").select("sig", "node")
    left = stored(left, "jaccard-kept")
    counted = left.groupBy("sig").agg(F.count("*").alias("of_sig")).filter("of_sig > 1")
    out = stored(left.join(counted.hint("merge"), "sig"), "jaccard-groups")
    forget(left)
    return out


def first_pairs(groups: DataFrame) -> DataFrame:
    """Pairs (a, b): all of each group of at most SMALL nodes; of larger ones each node with the smallest."""
    small = groups.filter(F.col("of_sig") <= SMALL).groupBy("sig").agg(F.sort_array(F.collect_set("node")).alias("g"))  # at most SMALL nodes
    pairs = small.select(F.explode(F.expr("flatten(transform(g, (a, i) -> transform(slice(g, i + 2, size(g)), b -> struct(b AS a, a AS b))))")).alias("p")).select("p.a", "p.b")
    large = groups.filter(F.col("of_sig") > SMALL).select("sig", "node")
    large = large.join(large.groupBy("sig").agg(F.min("node").alias("b")).hint("merge"), "sig").filter("node <> b").select(F.col("node").alias("a"), "b")
    return pairs.unionByName(large).distinct()


def similarity_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    texts = stored(described(docs, shingle, percent), "jaccard-texts")
    known = texts.filter("node IS NOT NULL")
    once, copied = copied_once(docs, texts, shingle)
    met = shared_signatures(docs, once, copied, shingle, percent)
    groups = groups_of(met, texts)
    wanted = stored(groups.select("node").distinct(), "jaccard-wanted")
    sets = stored(sets_of(docs, once, copied, wanted, shingle), "jaccard-sets")
    forget(met, once)
    firsts = stored(first_pairs(groups), "jaccard-firsts")
    links = linked(firsts, sets, percent)
    labels, apart, passed = components(links), None, []
    met = groups.filter(F.col("of_sig") > SMALL).select("sig", "node")
    for nearest_only in (True, True, False):
        placed = met.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
        of_sig = placed.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("of_sig"))
        placed = placed.join(of_sig.filter("low <> high").drop("low", "high").hint("merge"), "sig")
        before, apart = apart, stored(placed, "jaccard-apart")
        if before is not None:
            forget(before)
        if apart.isEmpty():
            break
        members = apart.join(sets.select("node", "sketch", "size"), "node")
        near = stored(apart_but_near(members, percent, nearest_only), "jaccard-near")
        met = apart.select("sig", "node").join(near.select("sig").distinct(), "sig", "left_semi")
        more = linked(near.select("a", "b").distinct(), sets, percent)
        if not more.isEmpty():
            known_links = labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
            older, labels = labels, components(known_links.unionByName(more))  # stars so far, and what joins them
            forget(older)
        forget(more)
        passed.append(near)

    nodes = known.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    owned = stored(nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "first_id"), "jaccard-owned")
    lowest = stored(owned.groupBy("label").agg(F.min("first_id").alias("component_id")), "jaccard-lowest")
    answers = stored(owned.join(lowest, "label").select(F.col("node").alias("_node"), "component_id"), "jaccard-answers")
    forget(groups, wanted, sets, firsts, links, apart, labels, owned, lowest, *passed)
    return texts.join(answers, texts["node"] == answers["_node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op9_jaccard_join(docs: DataFrame) -> DataFrame:
    return similarity_components(docs)


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + {SHINGLE - 1}], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {SHINGLE} + 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
         JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = w.doc_id
"""
