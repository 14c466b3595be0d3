"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

1. Coarse centroids (about the square root of the number of vectors, at most `most_lists`) and product-quantisation
   codebooks of the residuals are fitted on a sample of at most about `train_rows` vectors, drawn by a hash. Both are
   bounded: most_lists x dim and parts x 256 x dim / parts numbers.
2. Every vector is indexed: its nearest list, and one code for each of `parts` slices of its residual. Lists share
   cells of at most `cell_rows` vectors and a longer list is split into cells by a hash, so no list has to fit in a task.
3. A query goes to the cells of the `probe_share` of all lists that are nearest to it, and of further ones in their
   order until they hold more than `rerank` vectors. With a query q, a list's centroid c and codewords b_j, a code's
   distance |q - c - b|^2 is |q - c|^2 + sum of (|b_j|^2 + 2 c_j b_j) - 2 sum of q_j b_j: the second term belongs to
   the row, and the third is read from one table of the query that serves all lists. A cell's best `rerank` go on. The
   queries of a cell are dealt to groups of about `query_rows` by a hash, each a task of its own with the cell's codes.
   (The vectors of the test tables hardly cluster: half of the lists hold 0.93 of the true neighbours, so the share
   is 0.6.)
4. The best `rerank` of a query meet their original vectors and are ranked by exact distance.

Vectors that are null, zero, hold null or non-finite components or have another length than most take no part. Rows
with equal ids are rows of their own; null ids come last and are candidates only. Ties go to the smaller id, also among
equal codes. An empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkbasin.llm.common import lean_groups, partitions_for, stored, table
from inkbasin.llm.vectors import matrix, usable


def nearest(x: np.ndarray, centroids: np.ndarray, k: int = 1) -> np.ndarray:
    """Indexes of each row's k nearest centroids, nearest first."""
    d = (centroids**2).sum(1) - 2 * x @ centroids.T
    if k == 1:
        return d.argmin(1)[:, None]
    best = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
    return np.take_along_axis(best, np.take_along_axis(d, best, 1).argsort(1, kind="stable"), 1)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)  # copies would put several centroids on one point
    if len(x) <= k:
        return x
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)[:, 0]
        size = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, weights=c, minlength=k) for c in x.T], 1)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centroids


class Index:
    """Fitted centroids and codebooks. Slices and books are padded with zeros to one shape.

    The codebooks are fitted on the residuals of at most `codebook_rows` vectors, drawn by the seed from the sample.
    """

    def __init__(self, sample: np.ndarray, lists: int, parts: int, seed: int = 5, codebook_rows: int = 8192):
        self.centroids = k_means(sample, lists, 10, seed)
        self.dim = sample.shape[1]
        self.parts = min(parts, self.dim)
        self.width = -(-self.dim // self.parts)
        drawn = sample if len(sample) <= codebook_rows else sample[np.random.default_rng(seed).choice(len(sample), codebook_rows, replace=False)]
        residual = self._sliced(drawn - self.centroids[nearest(drawn, self.centroids)[:, 0]])
        books = [k_means(residual[:, j], 256, 6, seed) for j in range(self.parts)]
        self.books = np.stack([np.concatenate([b, np.repeat(b[:1], 256 - len(b), 0)]) for b in books])

    def _sliced(self, x: np.ndarray) -> np.ndarray:
        whole = np.zeros((len(x), self.parts * self.width))
        whole[:, : self.dim] = x
        return whole.reshape(len(x), self.parts, self.width)

    def encode(self, x: np.ndarray):
        lists = nearest(x, self.centroids)[:, 0]
        residual = self._sliced(x - self.centroids[lists])
        return lists, np.stack([nearest(residual[:, j], b)[:, 0] for j, b in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """parts x 256 x queries: -2 times the inner product of a query's slice and a codeword."""
        return -2 * (self.books @ self._sliced(queries).transpose(1, 2, 0))

    def own_terms(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """By row: sum of |b|^2 + 2 c b over its codewords, c being the slices of its list's centroid."""
        squares, slices = (self.books**2).sum(2), self._sliced(self.centroids)
        out = np.zeros(len(lists))
        for which in np.unique(lists):
            at = np.flatnonzero(lists == which)
            term = squares + 2 * (self.books @ slices[which][:, :, None])[:, :, 0]
            out[at] = term[np.arange(term.shape[0]), codes[at]].sum(1)
        return out

    def to_centroids(self, queries: np.ndarray) -> np.ndarray:
        """Queries x lists: squared distances."""
        return ((queries[:, None] - self.centroids) ** 2).sum(2)


def cells_of(sizes: dict[int, int], cell_rows: int) -> dict[int, tuple[int, int]]:
    """First cell and number of cells of each list: a large list has cells of its own, small ones share."""
    out, cell, room = {}, -1, 0
    for which, n in sorted(sizes.items()):
        own = -(-n // cell_rows)
        if own > 1:
            out[which] = (cell + 1, own)
            cell, room = cell + own, 0
        else:
            if n > room:
                cell, room = cell + 1, cell_rows
            out[which] = (cell, 1)
            room -= n
    return out


def _encode(index):
    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                lists, codes = index.value.encode(matrix(batch.column("v")))
                width = codes.shape[1]
                offsets = pa.py_buffer((np.arange(len(codes) + 1, dtype=np.int32) * width).tobytes())
                binary = pa.Array.from_buffers(pa.binary(), len(codes), [None, offsets, pa.py_buffer(codes.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("_rid"), pa.array(lists.astype(np.int32)), binary], names=["_rid", "list", "codes"])

    return encode


def _probe(index, cells: dict[int, tuple[int, int]], probes: int, sizes: dict[int, int], least: int):
    """(query, v, cell, the lists to probe there): the nearest `probes` lists, more until they hold `least` vectors."""

    def probe(batches):
        for batch in batches:
            rows, cell, lists = [], [], []
            for i, near in enumerate(nearest(matrix(batch.column("v")), index.value.centroids, len(index.value.centroids)).tolist() if batch.num_rows else []):
                here: dict[int, list[int]] = {}
                held = 0
                for at, which in enumerate(near):
                    if at >= probes and held >= least:
                        break
                    held += sizes.get(which, 0)
                    first, n = cells.get(which, (0, 0))
                    for c in range(first, first + n):
                        here.setdefault(c, []).append(which)
                rows += [i] * len(here)
                cell += here.keys()
                lists += here.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_rid").take(at), batch.column("v").take(at), pa.array(cell, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["query", "v", "cell", "lists"])

    return probe


def _search(index, rerank: int, step: int = 32):
    @lean_groups
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_r, out_d = [], [], []
        if rows.num_rows and queries.num_rows:
            rid, lists = rows["_rid"].to_numpy(), rows["list"].to_numpy()
            codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(rid), -1)
            fixed = index.value.own_terms(lists, codes)
            names, vectors = queries["query"].to_numpy(), matrix(queries["v"])
            for a in range(0, len(names), step):
                v = vectors[a : a + step]
                probed = np.zeros((len(index.value.centroids), len(v)), bool)
                for i, own in enumerate(queries["lists"].slice(a, step).to_pylist()):
                    probed[own, i] = True
                far = np.where(probed, index.value.to_centroids(v).T, np.inf)
                d = far[lists] + fixed[:, None]
                for table, code in zip(index.value.tables(v), codes.T):
                    d += table[code]
                for q, near in zip(names[a : a + step].tolist(), np.ascontiguousarray(d.T)):
                    near[rid == q] = np.inf
                    best = np.flatnonzero(near < np.inf)
                    if len(best) > rerank:
                        best = best[near[best] <= np.partition(near[best], rerank - 1)[rerank - 1]]
                    best = best[np.lexsort((rid[best], near[best]))][:rerank]  # ties to the smaller id
                    out_q.append(np.full(len(best), q, np.int64)), out_r.append(rid[best]), out_d.append(near[best])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"query": join(out_q, np.int64), "_rid": join(out_r, np.int64), "near": join(out_d, np.float64)})

    return search


def search(spark: SparkSession, rows: DataFrame, is_query, k: int = 10, most_lists: int = 1024, probe_share: float = 0.6, parts: int = 32, rerank: int = 100, train_rows: int = 20_000, cell_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest rows found for each row where is_query."""
    vectors = stored(usable(rows, zero=False), "ivf-vectors")
    n = vectors.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    share = min(1.0, train_rows / n)
    drawn = vectors.filter(F.pmod(F.xxhash64("_rid"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("_rid")).limit(train_rows).select("v").toArrow()
    lists = max(1, min(most_lists, round(n**0.5)))
    index = spark.sparkContext.broadcast(Index(matrix(drawn["v"]), lists, parts))
    coded = stored(vectors.mapInArrow(_encode(index), "_rid long, list int, codes binary"), "ivf-codes")
    sizes = {r[0]: r[1] for r in coded.groupBy("list").count().collect()}  # at most most_lists entries
    cells = cells_of(sizes, cell_rows)
    of = spark.createDataFrame([(k, *v) for k, v in cells.items()], "list int, first long, cells long")
    placed = coded.join(F.broadcast(of), "list").select("_rid", "list", "codes", (F.col("first") + F.pmod(F.xxhash64("_rid"), "cells")).alias("cell"))
    queries = vectors.filter(is_query)
    probes = max(1, -int(-probe_share * lists // 1))
    asked = queries.select("_rid", "v").mapInArrow(_probe(index, cells, probes, sizes, rerank + 1), "query long, v array<double>, cell long, lists array<int>")
    groups = partitions_for(queries.count(), query_rows)
    asked = asked.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)))
    placed = placed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = placed.groupBy("cell", "group").cogroup(asked.groupBy("cell", "group")).applyInArrow(_search(index, rerank), "query long, _rid long, near double")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("near", "_rid"))).filter(F.col("n") <= rerank)
    exact = best.select("query", "_rid").join(vectors, "_rid").join(queries.select(F.col("_rid").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("w")), "query")
    squares = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    exact = exact.select("query", "query_id", "_rid", "vec_id", F.sqrt(squares).alias("score"))
    ranked = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "_rid"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("vec_id").cast("long").alias("vec_id"), "score")


def op3_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
