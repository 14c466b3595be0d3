"""Exact top-k by inner product, pruned with multi-resolution segment statistics.

Vectors become integers, floor(scale * x). A vector is cut into 1, 4, 16 and 32 segments; each keeps its mean and its
deviation (the norm of what the mean leaves). For segments of length L with means m, n and deviations s, t,
    |x - q|^2 >= sum of L (m - n)^2 + (s - t)^2,
a lower bound of the distance that gets closer with more segments, and hence an upper bound of the inner product
(|x|^2 + |q|^2 - |x - q|^2) / 2. A pair that can't reach the query's k-th best score so far is dropped at the coarsest
resolution that shows it; the scores of the survivors are computed exactly. A resolution that drops next to nothing in
a step of rows is passed over in the following steps and tried again later, which changes the work and not the result.

All queries meet all rows in a grid of blocks: rows are dealt to blocks of `block_rows` and queries to groups of
`query_rows`, both by a hash, so each task holds one of each. Rows travel once for every query group and queries once
for every row block. With a query set that grows with the data, the pairs grow with its square, which is what is
asked for; nothing is broadcast or collected.

Vectors that are null, hold null or non-finite components or have another length than most take no part; zero vectors
do. Rows with equal ids are rows of their own; null ids come last and are candidates only. Ties go to the smaller id.
Scores beyond 64 bits are cut to that range. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkbasin.llm.common import lean_groups, partitions_for, stored, table
from inkbasin.llm.vectors import matrix, usable

LEVELS = (1, 4, 16, 32)
_STEP = 1024
#: A level that drops less than this share of a step's pairs rests for so many steps.
_WORTH, _REST = 0.02, 8


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """By row: root of the length times the mean, and deviation, of each segment; their inner products bound x's."""
    out = []
    for part in np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])):
        mean = x[:, part].mean(1)
        out += [mean * len(part) ** 0.5, np.sqrt(((x[:, part] - mean[:, None]) ** 2).sum(1))]
    return np.stack(out, 1)


def upper_bounds(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Queries x rows: (|x|^2 + |q|^2 - least squared distance) / 2, from statistics that keep the norms."""
    x, q = (rows**2).sum(1), (queries**2).sum(1)
    least = q[:, None] + x - 2 * queries @ rows.T
    return (q[:, None] + x - least) / 2


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of paired rows."""
    if len(x) and float(np.abs(x).max()) * float(np.abs(q).max()) * x.shape[1] >= 2.0**53:
        big = [sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(x, q)]
        return np.array([min(max(b, -(2**63)), 2**63 - 1) for b in big], np.int64)
    return np.einsum("ij,ij->i", x, q).astype(np.int64)


def _best(q: np.ndarray, rid: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query; sorted by query."""
    order = np.lexsort((rid, -score.astype(np.float64) if abs(score).max(initial=0) < 2**53 else np.array([-int(s) for s in score], object), q))
    q, rid, score = q[order], rid[order], score[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[place < k], rid[place < k], score[place < k]


def top(x: np.ndarray, rid: np.ndarray, queries: np.ndarray, query_rid: np.ndarray, k: int):
    """(query's index, rid, score) of each query's k best rows other than itself, and the pairs scored exactly.

    Rows come in steps, long vectors first, so that thresholds rise early. Many survivors of a step are scored by one
    matrix product, few pair by pair; only scores that reach the threshold are kept and sorted.
    """
    order = np.argsort(-(x**2).sum(1), kind="stable")
    x, rid = x[order], rid[order]
    small = len(x) and float(np.abs(x).max()) * float(np.abs(queries).max(initial=0)) * x.shape[1] < 2.0**53
    mine = [statistics(queries, s) for s in LEVELS]
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    least = np.full(len(queries), -np.inf)
    rests = [0] * len(LEVELS)
    scored = 0
    for a in range(0, len(x), _STEP):
        part, ids = x[a : a + _STEP], rid[a : a + _STEP]
        open_ = query_rid[:, None] != ids
        left = int(open_.sum())
        for i, (own, segments) in enumerate(zip(mine, LEVELS)):
            if not left or not a:  # nothing is known yet in the first step
                break
            if rests[i]:
                rests[i] -= 1
                continue
            qs, rows = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
            bound = upper_bounds(statistics(part[rows], segments), own[qs])
            bound += 1e-6 + 1e-9 * np.abs(bound)
            open_[np.ix_(qs, rows)] &= bound >= least[qs, None]
            before, left = left, int(open_.sum())
            if before - left < _WORTH * before:
                rests[i] = _REST
        scored += left
        if small and open_.mean() > 0.02:
            s = np.where(open_, queries @ part.T, -np.inf)
            if not a and len(part) > k:
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
            q, r = np.nonzero((s >= least[:, None]) & open_)
            s = s[q, r].astype(np.int64)
        else:
            q, r = np.nonzero(open_)
            s = np.concatenate([_exact(part[r[b : b + (1 << 16)]], queries[q[b : b + (1 << 16)]]) for b in range(0, len(q), 1 << 16)] or [np.zeros(0, np.int64)])
            keep = s >= least[q]
            q, r, s = q[keep], r[keep], s[keep]
        if len(q):
            found = _best(*(np.concatenate(p) for p in zip(found, (q, ids[r], s))), k)
            count = np.bincount(found[0], minlength=len(queries))
            least = np.where(count == k, found[2][np.maximum(np.cumsum(count) - 1, 0)], -np.inf)
    return found, scored


def _search(k: int):
    @lean_groups
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        q = r = s = np.zeros(0, np.int64)
        if rows.num_rows and queries.num_rows:
            names = queries["_rid"].to_numpy()
            (q, r, s), _ = top(matrix(rows["v"]), rows["_rid"].to_numpy(), matrix(queries["v"]), names, k)
            q = names[q]
        return pa.table({"query": q, "_rid": r, "score": s})

    return search


def search(spark: SparkSession, rows: DataFrame, is_query, k: int = 20, scale: int = 64, block_rows: int = 16_384, query_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row where is_query."""
    whole = usable(rows, zero=True).withColumn("v", F.transform("v", lambda x: _floor(x * scale)))
    vectors = stored(whole, "top-vectors")
    n = vectors.count()
    queries = vectors.filter(is_query)
    blocks, groups = partitions_for(n, block_rows), partitions_for(queries.count(), query_rows)
    mine = vectors.select("_rid", "v", F.pmod(F.xxhash64("_rid"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    asked = queries.select("_rid", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("_rid"), F.lit(groups)).alias("group"))
    found = mine.groupBy("group", "block").cogroup(asked.groupBy("group", "block")).applyInArrow(_search(k), "query long, _rid long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "_rid"))).filter(F.col("rank") <= k)
    ids = vectors.select("_rid", "vec_id")
    named = ranked.join(ids, "_rid").join(queries.select(F.col("_rid").alias("query"), F.col("vec_id").alias("query_id")), "query")
    return named.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")


def _floor(x):
    """Floor that stays a double, whatever its size."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def op5_segment_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
