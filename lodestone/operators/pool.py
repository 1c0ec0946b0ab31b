"""The shared pool of candidate spans of a text.

From the logits of boundaries (doc_id, query_id, pos, start_logit, end_logit, mask): the best starts
and ends over all queries, all pairs of them, each query's best pairs, then the best of the rest up
to the pool's capacity. All is by document, and pairs are made of the best places alone; no join is a
broadcast, as a few texts have many places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import grids
from ..functions.slices import ROWS, by_slices

MASK_LOGIT = -10_000.0
QUOTA_SCORE = 5_000.0


@dataclass(frozen=True)
class PoolConfig:
    top_k: int = 32
    capacity: int = 192
    per_query: int = 8


def union_logits(boundaries: DataFrame) -> DataFrame:
    """(doc_id, pos, valid, start_logit, end_logit): the greatest over valid queries; masked places get MASK_LOGIT. query_mask and mask: what is valid."""
    live = F.col("mask") & F.col("query_mask")
    return boundaries.groupBy("doc_id", "pos").agg(F.max(live).alias("valid"), *(F.max(F.when(live, F.col(c)).otherwise(MASK_LOGIT)).alias(c) for c in ("start_logit", "end_logit")))


def top_boundaries(union: DataFrame, column: str, k: int) -> DataFrame:
    """(doc_id, pos, valid, logit, rank): the k best places, by logit and then place; those that aren't valid stand for place 0."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(column), "pos")
    ranked = union.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("doc_id", F.when(F.col("valid"), F.col("pos")).otherwise(0).alias("pos"), "valid", F.col(column).alias("logit"), "rank")


def best_places(union: DataFrame, k: int) -> DataFrame:
    """(doc_id, starts, ends): the best places of a text, each an array of (pos, valid, logit, rank)."""
    side = lambda s: top_boundaries(union, f"{s}_logit", k).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "valid", "logit", "rank")).alias(f"{s}s"))
    return side("start").join(side("end").hint("merge"), "doc_id")


def each_pair(lists: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each of a row's starts and ends, in the columns s and e."""
    return lists.select(*keep, "ends", F.explode("starts").alias("s")).select(*keep, "s", F.explode("ends").alias("e"))


def query_quota(boundaries: DataFrame, union: DataFrame, config: PoolConfig, compat) -> DataFrame:
    """Each query's best pairs of the best places, with scores above any other's, as rows. compat: an expression of a start and an end."""
    of = lambda s: F.map_from_entries(F.transform(F.filter(s, lambda x: x["valid"]), lambda x: F.struct(x["pos"].alias("k"), x.alias("v")))).alias(s)
    places = best_places(union, config.top_k).select("doc_id", of("starts"), of("ends"))
    at = boundaries.filter("query_mask").select("doc_id", "query_id", "pos", "start_logit", "end_logit").join(places.hint("shuffle_hash"), "doc_id")
    at = at.withColumns({"s": F.col("starts")[F.col("pos")], "e": F.col("ends")[F.col("pos")]}).filter("s IS NOT NULL OR e IS NOT NULL")
    side = lambda s: F.collect_list(F.when(F.col(s[0]).isNotNull(), F.struct("pos", F.col(f"{s}_logit").alias("own"), F.col(f"{s[0]}.logit"), F.col(f"{s[0]}.rank")))).alias(f"{s}s")
    scored = each_pair(at.groupBy("doc_id", "query_id").agg(side("start"), side("end")), ["doc_id", "query_id"]).withColumns({"start": F.col("s.pos"), "end": F.col("e.pos")})
    scored = scored.filter(F.col("end") > F.col("start")).withColumns({"compat": compat(F.col("start"), F.col("end")), "pair": (F.col("s.rank") - 1) * config.top_k + F.col("e.rank") - 1})
    order = Window.partitionBy("doc_id", "query_id").orderBy(F.desc("own"), "pair")
    ranked = scored.withColumn("own", F.col("s.own") + F.col("e.own") + F.col("compat")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= config.per_query)
    return ranked.select("doc_id", "start", "end", F.lit(True).alias("valid"), "compat", (F.lit(QUOTA_SCORE) + config.per_query - F.col("r") + 1).alias("score"), "pair", F.col("s.logit").alias("s_logit"), F.col("e.logit").alias("e_logit"))


def placed(boundaries: DataFrame, k: int) -> DataFrame:
    """(doc_id, at): the boundaries of a text's best places, of each query, with what the places are worth over all queries. start_rank and end_rank: above k where a place isn't among the best of that side."""
    union = union_logits(boundaries)
    rank = lambda s: F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(f"{s}_logit"), "pos"))
    best = union.withColumns({"start_rank": rank("start"), "end_rank": rank("end")}).filter((F.col("start_rank") <= k) | (F.col("end_rank") <= k))
    worth = F.struct("start_rank", "end_rank", "valid", *(F.col(f"{s}_logit").alias(f"{s}_best") for s in ("start", "end")))
    lists = best.groupBy("doc_id").agg(F.collect_list(F.struct("pos", worth.alias("w"))).alias("_p")).select("doc_id", F.col("_p.pos").alias("_at"), F.col("_p.w").alias("_w"))
    own = boundaries.select("doc_id", "query_id", "pos", "start_logit", "end_logit", "query_mask").join(lists.hint("shuffle_hash"), "doc_id")
    own = own.withColumn("_i", F.array_position("_at", F.col("pos")).cast("int")).filter("_i > 0").withColumn("_w", F.get("_w", F.col("_i") - 1))
    return own.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "pos", "start_logit", "end_logit", "query_mask", "_w.*")).alias("at"))


POOLED = "array<struct<slot:int,start:int,end:int,compat:double,proposal:double>>"


def pooled(texts: pa.StructArray, config: PoolConfig, compat=None) -> pa.Array:
    """Of some texts at once the pool's spans. texts: (doc_id, at), as in placed()."""
    ids, at = texts.flatten()
    k, n = config.top_k, len(at)
    doc = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(at), 0).to_numpy(zero_copy_only=False))
    flat = at.flatten()
    x = {f.name: pc.struct_field(flat, [i]).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    place = np.where(x["valid"], x["pos"], 0)  # those that aren't valid stand for place 0
    side = {}
    for s in ("start", "end"):
        own = x[f"{s}_rank"] <= k
        index = doc[own], x[f"{s}_rank"][own] - 1
        pos, best, valid, here = np.zeros((n, k), np.int64), np.zeros((n, k)), np.zeros((n, k), bool), np.zeros((n, k), bool)
        pos[index], best[index], valid[index], here[index] = place[own], x[f"{s}_best"][own], x["valid"][own], True
        side[s] = pos, best, valid, here, own & x["valid"] & x["query_mask"]
    (starts, start_best, start_valid, start_here, start_asked), (ends, end_best, end_valid, end_here, end_asked) = side["start"], side["end"]
    pair = lambda a, b: (np.broadcast_to(a[:, :, None], (n, k, k)).reshape(n, -1), np.broadcast_to(b[:, None, :], (n, k, k)).reshape(n, -1))
    start, end = pair(starts, ends)
    live = np.logical_and(*pair(start_valid, end_valid)) & (end > start)
    fits = np.zeros((n, k * k)) if compat is None else compat(ids.to_numpy(zero_copy_only=False)[:, None], start, end)
    a, b = pair(start_best, end_best)
    proposal = fits + a + b
    score = np.where(live, proposal, -np.inf)
    beaten = []  # of two rows for a pair, its own and its query's, the worse
    for query in np.unique(x["query_id"][start_asked | end_asked]):
        asked = {}
        for s, of in (("start", start_asked), ("end", end_asked)):
            mine = of & (x["query_id"] == query)
            asked[s] = np.full((n, k), -np.inf)
            asked[s][doc[mine], x[f"{s}_rank"][mine] - 1] = x[f"{s}_logit"][mine]
        a, b = pair(asked["start"], asked["end"])
        own = np.where(live, a + b + fits, -np.inf)
        d, i, r = best_of(own, config.per_query)
        np.maximum.at(score, (d, i), QUOTA_SCORE + config.per_query - r)
        beaten.append((d, i))
    d, i, r = best_of(score, config.capacity, start, end)
    if (score[d, i] <= MASK_LOGIT).any():  # then what isn't valid or is beaten goes before some
        away = [np.nonzero(np.logical_and(*pair(start_here, end_here)) & ~live), *beaten]
        e, j = (np.concatenate([y[c] for y in away]) for c in (0, 1))
        every, column = np.concatenate([d, e]), np.concatenate([i, j])
        value = np.concatenate([score[d, i], np.full(len(e), MASK_LOGIT)])
        order = np.lexsort((end[every, column], start[every, column], -value, every))
        slot = np.empty(len(every), np.int64)
        slot[order] = np.arange(len(every)) - np.searchsorted(every[order], every[order])
        kept = slot[: len(d)] < config.capacity
        d, i, r = d[kept], i[kept], slot[: len(d)][kept]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))]).astype(np.int32)
    columns = [r.astype(np.int32), start[d, i].astype(np.int32), end[d, i].astype(np.int32), fits[d, i], proposal[d, i]]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in columns], ["slot", "start", "end", "compat", "proposal"]))


def best_of(values: np.ndarray, most: int, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greatest finite values of each row, by value, ties and place: their rows, columns and ranks from 0."""
    if values.shape[1] > most:
        least = np.partition(values, -most, axis=1)[:, -most, None]
        near = (values >= least) & (values > -np.inf)
    else:
        near = values > -np.inf
    row, column = np.nonzero(near)
    order = np.lexsort((column, *(t[row, column] for t in reversed(ties)), -values[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    kept = rank < most
    return row[kept], column[kept], rank[kept]


SLOTS = "array<struct<slot:int,start:int,end:int>>"


def best_of_places(ids: np.ndarray, n_words: np.ndarray, origins: np.ndarray, queries: list[int], scores, k: int) -> pa.StructArray:
    """(doc_id, at) as placed() gives them, where no place and no query is masked; places are scored as arrays. scores: a provider's boundary_array."""
    over, parts = np.cumsum(n_words + 1), []
    for begin in range(0, int(over[-1]) if len(over) else 0, grids.PLACES):
        place = np.arange(begin, min(begin + grids.PLACES, int(over[-1])))
        text = np.searchsorted(over, place, "right")
        pos = place - (over - n_words - 1)[text]
        own = [[grids.finite(np.broadcast_to(x, pos.shape), "boundary_logits", ids[text], q) for x in scores(ids[text], pos - origins[text], q)] for q in queries]
        logits = np.array(own, float)  # query, side, place
        best = logits.max(0)
        near = (best[0] >= grids.kth(best[0], text, k)) | (best[1] >= grids.kth(best[1], text, k))
        parts.append((text[near], pos[near], logits[:, :, near]))
    text, pos = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, int) for i in (0, 1))
    logits = np.concatenate([p[2] for p in parts], 2) if parts else np.zeros((len(queries), 2, 0))
    best, ranks = logits.max(0), []
    for side in best:
        order = np.lexsort((pos, -side, text))
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text)) - np.searchsorted(text[order], text[order]) + 1
        ranks.append(rank)
    kept = (ranks[0] <= k) | (ranks[1] <= k)
    text, pos, logits, best, ranks = text[kept], pos[kept], logits[:, :, kept], best[:, kept], [r[kept] for r in ranks]
    each = lambda x: np.repeat(x, len(queries))
    live = np.ones(len(text) * len(queries), bool)
    columns = {"query_id": np.tile(queries, len(text)), "pos": each(pos), "start_logit": logits[:, 0].T.ravel(), "end_logit": logits[:, 1].T.ravel(), "query_mask": live}
    columns |= {"start_rank": each(ranks[0]), "end_rank": each(ranks[1]), "valid": live, "start_best": each(best[0]), "end_best": each(best[1])}
    return pa.StructArray.from_arrays([pa.array(ids), grids.lists(each(text), len(ids), columns)], ["doc_id", "at"])


def candidates_in_row(docs: DataFrame, origin, queries: list[int], scores, config: PoolConfig = PoolConfig()) -> DataFrame:
    """(doc_id, _k): as candidate_lists(), in the row of the text; places become no rows. docs: doc_id, n_words, a prefix' words included; origin: where the text's own begin."""

    def cut(texts: pa.StructArray) -> pa.Array:
        ids, n_words, origins = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in texts.flatten())
        found = pooled(best_of_places(ids, n_words, origins, queries, scores, config.top_k), config)
        flat = found.values
        return pa.ListArray.from_arrays(found.offsets, pa.StructArray.from_arrays([flat.field(i) for i in range(3)], ["slot", "start", "end"]))

    rows = max(1, min(ROWS, (1 << 17) // config.top_k**2))
    return docs.select("doc_id", by_slices(SLOTS, cut, rows).asNondeterministic()(F.struct("doc_id", "n_words", origin)).alias("_k"))


def candidate_lists(boundaries: DataFrame, config: PoolConfig = PoolConfig(), compat=None) -> DataFrame:
    """(doc_id, _k): the pool of a text as an array of (slot, start, end, compat, proposal)."""
    rows = max(1, min(ROWS, (1 << 17) // config.top_k**2))
    cut = by_slices(POOLED, lambda texts: pooled(texts, config, compat), rows).asNondeterministic()  # once, whatever columns are read
    return placed(boundaries, config.top_k).select("doc_id", cut(F.struct("doc_id", "at")).alias("_k"))


def candidate_pool(boundaries: DataFrame, config: PoolConfig = PoolConfig(), compat=None) -> DataFrame:
    """(doc_id, slot, start, end, compat, proposal) of the pool's spans. compat: a function of arrays of ids, starts and ends.

    Pairs that aren't valid take part in the cut with MASK_LOGIT and are dropped after it. A text's best places, of which
    there are few, are gathered with their boundaries; its pairs are arrays in a few texts' batch and never rows.
    """
    return candidate_lists(boundaries, config, compat).select("doc_id", F.inline("_k"))
