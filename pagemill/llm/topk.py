"""Exact top-k inner products by the three-phase uniform threshold method.

The dimensions are cut in ``LISTS`` runs. In each block of candidates every run
is a list of local scores, whose sum is the score. For each query:

1. every list gives its k best entries; the scores of these candidates are made
   whole, and the k-th best over all blocks is a safe cutoff: at least k
   candidates reach it;
2. the cutoff goes back to all blocks with the query. A candidate can only reach
   it if one of its local scores reaches the LISTS-th part, so the entries above
   that part are sufficient; those whose local score plus the best of the other
   lists stays below the cutoff are left out;
3. what is left is scored exactly; the k best of each block meet in the result.

Queries meet candidates in blocks of bounded size, so no table is broadcast and
no task holds more than one block of each. Each block sends k rows a query at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

LISTS = 2
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
_STRIP = 256  # queries scored at once: 256 x 4096 doubles are 8 MB
_EXACT = float(2 ** 53)


def scaled(vectors: DataFrame, factor: int = 64) -> DataFrame:
    """vec_id, v: floor(factor * x) of every component as a whole number.

    Rows with a null id, a null vector or a null or non-finite component take no part. Components
    are held as doubles, which are exact here: larger ones than 2^53 are refused when they are scored.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("double"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(frame: pd.DataFrame, column: str = "v") -> np.ndarray:
    return np.array(frame[column].tolist(), dtype=np.float64).reshape(len(frame), -1)


def _blocks(queries: pd.DataFrame, candidates: pd.DataFrame):
    """(ids of a strip of queries, ids of candidates, one score matrix a list) for each length of vector."""
    q_size, c_size = queries["v"].map(len), candidates["w"].map(len)
    for size in sorted(set(q_size) & set(c_size)):
        c = candidates[c_size == size].sort_values("cand", kind="stable")
        q_all = queries[q_size == size]
        whole = _matrix(c, "w")
        most = np.abs(whole).max(initial=0.0) * np.abs(_matrix(q_all)).max(initial=0.0) * size
        if most >= _EXACT:
            raise ValueError("inner products beyond 2^53 are not exact")
        cuts = np.linspace(0, size, LISTS + 1).astype(int)
        parts = [np.ascontiguousarray(whole[:, a:b].T) for a, b in zip(cuts, cuts[1:])]
        for at in range(0, len(q_all), _STRIP):
            q = q_all.iloc[at:at + _STRIP]
            vectors = _matrix(q)
            scores = [vectors[:, a:b] @ p for (a, b), p in zip(zip(cuts, cuts[1:]), parts)]
            yield q, c["cand"].to_numpy(), scores


def _first_lists(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, ids, lists in _blocks(queries, candidates):
            n = len(ids)
            total = sum(lists)
            near = np.zeros(total.shape, bool)
            for scores in lists:
                top = np.argpartition(-scores, k, axis=1)[:, :k + 1] if n > k + 1 else np.arange(n)[None, :]
                np.put_along_axis(near, np.broadcast_to(top, (len(q), top.shape[1])), True, axis=1)
            near &= ids[None, :] != q["vec_id"].to_numpy()[:, None]
            for row, qid in enumerate(q["vec_id"].to_numpy()):
                found = total[row, near[row]]
                out.append((qid, np.sort(found)[::-1][:k].astype(np.int64)))
        return pd.DataFrame(out, columns=["query_id", "scores"])

    return run


def _above(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        ids_out, cand_out, score_out = [], [], []
        for q, ids, lists in _blocks(queries, candidates):
            cutoff = q["cutoff"].fillna(-np.inf).to_numpy(np.float64)[:, None]
            best = [s.max(axis=1, keepdims=True) for s in lists]
            rest = [sum(b for j, b in enumerate(best) if j != i) for i in range(len(lists))]
            enough = np.zeros(lists[0].shape, bool)
            for scores, others in zip(lists, rest):
                enough |= scores >= np.maximum(cutoff / len(lists), cutoff - others)
            enough &= ids[None, :] != q["vec_id"].to_numpy()[:, None]
            rows, places = np.nonzero(enough)
            exact = sum(s[rows, places] for s in lists)
            keep = exact >= cutoff[rows, 0]
            rows, places, exact = rows[keep], places[keep], exact[keep]
            order = np.lexsort((ids[places], -exact, rows))
            rows, places, exact = rows[order], places[order], exact[order]
            starts = np.searchsorted(rows, rows)  # of each row's query
            keep = np.arange(len(rows)) - starts < k
            ids_out.append(q["vec_id"].to_numpy()[rows[keep]])
            cand_out.append(ids[places[keep]])
            score_out.append(exact[keep].astype(np.int64))
        if not ids_out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return pd.DataFrame({"query_id": np.concatenate(ids_out), "vec_id": np.concatenate(cand_out),
                             "score": np.concatenate(score_out)})

    return run


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Both tables come from ``scaled``. A candidate with the query's own id is left out. Repeated candidate rows
    count once for each row; repeated query ids are asked once. Only vectors of the query's length are compared;
    with fewer than k of them all are returned, with none the query has no row.
    """
    n_q, n_c = queries.count(), candidates.count()
    q_blocks, c_blocks = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_c // CANDIDATE_BLOCK))

    def numbered(n: int, name: str):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    spread = F.pmod(F.xxhash64("vec_id", "v"), F.lit(c_blocks)).cast("int")
    asked = queries.dropDuplicates(["vec_id"]).select("vec_id", "v", own(q_blocks).alias("qb"))
    c_rows = candidates.select(F.col("vec_id").alias("cand"), F.col("v").alias("w"), spread.alias("cb"),
                               numbered(q_blocks, "qb"))
    q_rows = asked.select("vec_id", "v", "qb", numbered(c_blocks, "cb"))

    lists = q_rows.groupBy("qb", "cb").cogroup(c_rows.groupBy("qb", "cb")).applyInPandas(
        _first_lists(k), "query_id long, scores array<long>")
    # of a query's lists only the k best scores so far are needed: one row a block, k numbers each
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s")))
    cutoffs = (
        lists.select("query_id", F.explode("scores").alias("s")).withColumn("place", place)
        .where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("s").alias("cutoff"))
    )
    told = asked.join(cutoffs, "vec_id", "left").select("vec_id", "v", "cutoff", "qb", numbered(c_blocks, "cb"))
    found = told.groupBy("qb", "cb").cogroup(c_rows.groupBy("qb", "cb")).applyInPandas(
        _above(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
