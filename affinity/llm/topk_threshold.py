"""Exact top-k inner products in three phases with a uniform threshold.

Vectors become integer vectors, cut into blocks of dimensions: a task holds
one block of one shard of candidates and so knows a partial score only.
Phase 1 gathers the best partial scores of every query from all tasks and
resolves those candidates; the k-th best of them is a safe cutoff, because at
least k candidates reach it.  Phase 2 hands every task the cutoff divided by
the number of blocks: a candidate that is below this in every block is below
the cutoff, so only entries at or above it are collected.  Phase 3 computes the
exact score of what is left and ranks it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinity.llm.common import cut

BLOCKS = 2
# Candidates per shard and queries per group at most, on average; both bound a task's matrix.
SHARD_ROWS, GROUP_ROWS = 16_384, 2_048
MIN_SHARDS = 16
# Candidates scored at once; bounds the memory of a task.
SLICE = 2_048


def integer_vectors(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(id, v): v = floor(scale * x) as BIGINTs, for vectors of finite components.

    Null vectors, vectors with null or non-finite components and rows without
    an id take no part; rows that repeat an id count once (the smallest vector).
    Components beyond a BIGINT become its ends, which ``top_k`` rejects.
    """
    x = F.col("x")
    good = F.col("x").isNotNull() & F.col("id").isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where(F.coalesce(good, F.lit(False)))
            .select("id", F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def _matrix(cells, width: int) -> np.ndarray:
    """Integer rows, padded with zeros."""
    out = np.zeros((len(cells), width), np.int64)
    for k, c in enumerate(cells):
        out[k, :len(c)] = c
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of int64 matrices (float64 BLAS where that is exact)."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if bound < 2 ** 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _at_least_kth(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all entries at or above the k-th best of their row."""
    if scores.shape[1] <= k:
        return np.nonzero(np.ones(scores.shape, bool))
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    return np.nonzero(scores >= kth[:, None])


def _k_best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pd.DataFrame:
    """The k best (score, then smaller id) of every query."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.ones(len(query), bool)
    first[1:] = query[1:] != query[:-1]
    starts = np.flatnonzero(first)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    keep = place < k
    return pd.DataFrame({"query": query[keep], "id": ids[keep], "score": scores[keep]})


def _lists(query: np.ndarray, ids: np.ndarray, grp: int, shard: int) -> pd.DataFrame:
    """One row per query with the list of its candidates in this shard."""
    order = np.argsort(query, kind="stable")
    query, ids = query[order], ids[order]
    asked, starts = np.unique(query, return_index=True)
    return pd.DataFrame({"shard": np.full(len(asked), shard, "int32"), "grp": np.full(len(asked), grp, "int32"),
                         "query": asked, "ids": pd.Series(np.split(ids, starts[1:])[:len(asked)], dtype=object)})


_LIST = "shard int, grp int, query long, ids array<long>"
_LOW = np.iinfo(np.int64).min


def _partial_scores(cands: pd.DataFrame, asked: pd.DataFrame) -> Iterator[tuple]:
    """(scores, ids, query ids, own) for slices of the candidates."""
    wide = max([0, *map(len, cands["v"]), *map(len, asked["v"])])
    q, qid, ids = _matrix(asked["v"], wide), asked["id"].to_numpy(), cands["id"].to_numpy()
    for at in range(0, len(ids), SLICE):
        part = slice(at, at + SLICE)
        yield products(q, _matrix(cands["v"].iloc[part], wide)), ids[part], qid, qid[:, None] == ids[part][None, :]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, blocks: int = BLOCKS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query.

    ``vectors`` and ``queries`` have (id, v) with integer vectors; if the largest
    component of each, times the length, reaches 2^63, scores may not fit a
    BIGINT and ValueError is raised.  Ids are distinct and not null (see ``integer_vectors``).  A
    query's own id is no candidate; ties go to the smaller id; fewer than k
    candidates give as many rows.  Shorter vectors count as padded with zeros.
    Empty inputs give an empty result.
    """
    vectors, queries = cut(vectors, "topk-vectors"), cut(queries, "topk-queries")
    most = F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))).alias("m")
    shape, asked = (rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), most).first()
                    for rows in (vectors, queries))
    width = max(1, shape["d"] or 0, asked["d"] or 0)
    if (shape["m"] or 0) * (asked["m"] or 0) * width >= 2 ** 63:
        raise ValueError("inner products of these components may not fit 64 bits")
    n_shards, n_groups = max(MIN_SHARDS, -(-shape["n"] // SHARD_ROWS)), max(1, -(-asked["n"] // GROUP_ROWS))
    bounds = [width * b // blocks for b in range(blocks + 1)]
    shard, grp = (F.pmod(F.xxhash64("id"), F.lit(n)).cast("int") for n in (n_shards, n_groups))
    every = {name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
             for name, n in (("shard", n_shards), ("grp", n_groups))}
    # every task pairs one shard with one group: n_groups copies of a vector, n_shards of a query
    cands = vectors.select("id", "v", shard.alias("shard")).select("*", every["grp"])

    def by_block(rows: DataFrame):
        cut_up = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.slice("v", lo + 1, hi - lo).alias("v"))
                                     for b, (lo, hi) in enumerate(zip(bounds, bounds[1:]))])).alias("p")
        keep = [c for c in rows.columns if c != "v"]
        return rows.select(*keep, cut_up).select(*keep, "p.block", "p.v").groupBy("shard", "grp", "block")

    def gather(key: tuple, found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        best = pd.DataFrame({"query": [], "id": [], "score": []}, dtype="int64")
        for got, ids, qid, own in _partial_scores(found, asked) if len(asked) else ():
            got[own] = _LOW
            r, c = _at_least_kth(got, k)
            keep = got[r, c] > _LOW
            r, c = r[keep], c[keep]
            best = _k_best(np.append(best["query"], qid[r]), np.append(best["id"], ids[c]),
                           np.append(best["score"], got[r, c]), k)
        return _lists(best["query"].to_numpy(), best["id"].to_numpy(), key[1], key[0])

    def collect(key: tuple, found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        query, listed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(asked):
            # whole scores are integers: one block must reach the mean, rounded up
            least = np.array([_LOW if t is None else -(-int(t) // blocks) for t in asked["cutoff"]], np.int64)
            for got, ids, qid, own in _partial_scores(found, asked):
                r, c = np.nonzero((got >= least[:, None]) & ~own)
                query.append(qid[r])
                listed.append(ids[c])
        return _lists(np.concatenate(query), np.concatenate(listed), key[1], key[0])

    def exact(key: tuple, found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        best = [pd.DataFrame({"query": [], "id": [], "score": []}, dtype="int64")]
        if len(found) and len(asked):
            found = found.sort_values("id")
            ids, v = found["id"].to_numpy(), _matrix(found["v"], width)
            for query, q, listed in zip(asked["query"], _matrix(asked["v"], width), asked["ids"]):
                at = np.searchsorted(ids, np.asarray(listed, np.int64))
                got = products(q[None, :], v[at])[0]
                best.append(_k_best(np.full(len(at), query), ids[at], got, k))
        return pd.concat(best)

    def resolve(lists: DataFrame) -> DataFrame:
        """(query, id, score): exact scores of listed candidates, the k best of each shard."""
        lists = lists.groupBy("shard", "grp", "query").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        listed = lists.join(queries.withColumnRenamed("id", "query"), "query")
        return cands.groupBy("shard", "grp").cogroup(listed.groupBy("shard", "grp")).applyInPandas(
            exact, "query long, id long, score long")

    def tasks(rows: DataFrame, run) -> DataFrame:
        dealt = rows.select("*", grp.alias("grp")).select("*", every["shard"])
        return cut(by_block(cands).cogroup(by_block(dealt)).applyInPandas(run, _LIST), "topk-lists")

    # 1: local lists of partial scores, resolved; the k-th best is the cutoff (none with fewer than k)
    first = resolve(tasks(queries, gather))
    ranked = first.groupBy("query").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    cutoff = cut(ranked.where(F.size("s") >= k).select("query", F.element_at("s", k).cast("string").alias("cutoff")), "topk-cutoff")
    # 2: all that may still reach it
    with_cutoff = queries.join(cutoff, queries["id"] == cutoff["query"], "left").select("id", "v", "cutoff")
    # 3: exact scores of those
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, k)
    return (resolve(tasks(with_cutoff, collect)).groupBy("query").agg(best.alias("best"))
            .select(F.col("query").alias("query_id"), F.posexplode("best").alias("rank", "b"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"),
                    (-F.col("b.s")).alias("score")))
