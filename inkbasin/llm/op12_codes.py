"""Codes of vectors: each part of a vector becomes the index of the nearest entry of that part's codebook.

Codebooks begin as the first vectors and are refined in rounds over all rows: every task sums its parts by entry, Spark
adds the sums, and a few thousand numbers (parts x entries x components) come to the driver. The nearest entry is found
in a ball tree over the entries of a part: centres are integer points, radii are rounded up and lower bounds down, a
ball is visited unless its bound is strictly beyond the best distance so far (an equal one may hold a lower index), and
every comparison that decides is one of integers.

Left out: null vectors, those holding null or non-finite components, and those of another length than most have.
Repeated and null ids are rows like others (nulls last in the order of the first vectors; ties by vector, then label).
An empty table gives no rows, fewer rows than entries a smaller codebook. A length that the parts don't divide is cut at
floor(i * length / parts). Distances must fit 62 bits, or it is an error: components up to 2^27 do for parts of up to 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbasin.llm.common import lean, small_batches, stored, table
from inkbasin.llm.vectors import matrix

#: Sums of errors by label are broadcast up to so many labels (24 bytes each), and joined by shuffle beyond.
MOST_SENT = 100_000
#: Rows that descend a tree together.
TOGETHER = 4096


def _up(x):
    return np.nextafter(x, np.inf)


def _down(x):
    return np.nextafter(x, -np.inf)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.square(a - b).sum(-1)


class BallTree:
    """Exact nearest entry of an integer codebook (entries x components), ties to the lower index."""

    def __init__(self, book: np.ndarray, leaf: int = 6):
        self.book, self.leaf = book, leaf
        #: Distances to entries that were computed, for tests.
        self.scored = 0
        self.root = self._node(np.arange(len(book)))

    def _node(self, entries: np.ndarray):
        """(centre, radius, entries, children); leaves have no children and their entries in ascending order."""
        points = self.book[entries]
        centre = points.sum(0) // len(points)
        radius = _up(np.sqrt(_up(_squared(points, centre).max().astype(float))))
        spread = points.max(0) - points.min(0)
        if len(entries) <= self.leaf or not spread.any():
            return centre, radius, np.sort(entries), ()
        order = entries[np.argsort(points[:, spread.argmax()], kind="stable")]
        half = len(order) // 2
        return centre, radius, entries, (self._node(order[:half]), self._node(order[half:]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each point."""
        index, best = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        for a in range(0, len(points), TOGETHER):
            b = slice(a, a + TOGETHER)
            self._visit(self.root, points[b], np.arange(len(points[b])), index[b], best[b])
        return index, best

    def _visit(self, node, points, rows, index, best) -> None:
        if not len(rows):
            return
        if not node[3]:
            self.scored += len(rows) * len(node[2])
            d = _squared(points[rows, None, :], self.book[node[2]])
            at = d.argmin(1)
            d, found = d[np.arange(len(rows)), at], node[2][at]
            better = (d < best[rows]) | (d == best[rows]) & (found < index[rows])
            index[rows[better]], best[rows[better]] = found[better], d[better]
            return
        low, high = node[3]
        bounds = [_down(_down(np.sqrt(_down(_squared(points[rows], child[0]).astype(float)).clip(0))) - child[1]) for child in (low, high)]
        first = bounds[0] <= bounds[1]
        for mine, order in ((first, (0, 1)), (~first, (1, 0))):
            for k in order:
                to = rows[mine]
                open_ = bounds[k][mine] <= _up(np.sqrt(_up(best[to].astype(float))))
                self._visit(node[3][k], points, to[open_], index, best)


def _integers(column, scale: int, parts: int) -> np.ndarray:
    v = np.floor(scale * matrix(column).astype(np.float64))
    width = -(-v.shape[1] // parts) if len(v) else 0
    if len(v) and not 4 * np.abs(v).max() ** 2 * width < 2.0**62:
        raise OverflowError("vectors whose squared distances don't fit 62 bits")
    return v.astype(np.int64)


def _cuts(length: int, parts: int) -> list[tuple[int, int]]:
    return [(i * length // parts, (i + 1) * length // parts) for i in range(parts)]


def kept(rows: DataFrame) -> DataFrame:
    """The rows of (embedding, ...) that can be coded: see the module's text."""
    v = F.col("embedding")
    whole = rows.filter(F.size("embedding") > 0).filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))))
    length = whole.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return whole if length is None else whole.filter(F.size("embedding") == length[0])


def fit(rows: DataFrame, by: str, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """The codebooks, one array (entries x components) for each part, from all of rows (kept)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits for each part")
    first = rows.orderBy(F.col(by).asc_nulls_last(), "embedding", *[c for c in rows.columns if c not in (by, "embedding")]).limit(entries)
    seeds = [r[0] for r in first.select("embedding").collect()]
    if not seeds:
        return []
    start = _integers(pa.array(seeds, pa.list_(pa.float64())), scale, parts)
    books = [start[:, a:b] for a, b in _cuts(start.shape[1], parts)]
    for _ in range(rounds):
        sums = rows.select("embedding").mapInArrow(lean(_summed(books, scale)), "part int, entry int, place int, n long, s long")
        new = [b.copy() for b in books]
        for part, entry, place, n, s in sums.groupBy("part", "entry", "place").agg(F.sum("n"), F.sum("s")).collect():
            new[part][entry, place] = s // n
        books = new
    return books


def _summed(books: list[np.ndarray], scale: int):
    """Of each task one row for each component of each entry that a part chose: how often, and the sum."""

    def rows(batches):
        trees = [BallTree(b) for b in books]
        n = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            v, a = _integers(batch.column(0), scale, len(books)), 0
            for k, tree in enumerate(trees):
                part = v[:, a : a + tree.book.shape[1]]
                a += tree.book.shape[1]
                chosen = tree.nearest(part)[0] if len(v) else np.zeros(0, np.int64)
                n[k] += np.bincount(chosen, minlength=len(n[k]))
                np.add.at(sums[k], chosen, part)
        for k, total in enumerate(sums):
            entry, place = np.nonzero(n[k][:, None] + 0 * total)
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(entry), k, np.int32)), "entry": pa.array(entry.astype(np.int32)), "place": pa.array(place.astype(np.int32)), "n": n[k][entry], "s": total[entry, place]})

    return rows


def _coded(books: list[np.ndarray], scale: int):
    def rows(batches):
        trees = [BallTree(b) for b in books]
        for batch in batches:
            v, a = _integers(batch.column("embedding"), scale, len(books)), 0
            codes, error = np.zeros((len(v), len(books)), np.uint8), np.zeros(len(v), np.int64)
            for k, tree in enumerate(trees):
                chosen, d = tree.nearest(v[:, a : a + tree.book.shape[1]])
                a += tree.book.shape[1]
                codes[:, k] = chosen
                error += d
            text = codes.tobytes().hex()
            each = max(2 * len(books), 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "embedding"), pa.array([text[i : i + each] for i in range(0, len(text), each)], pa.string()), pa.array(error)], names=[*(c for c in batch.schema.names if c != "embedding"), "code", "error"])

    return rows


def books_hash(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], scale: int = 256) -> DataFrame:
    """rows (vec_id, label, embedding; kept) with code and error in place of the vector."""
    small_batches(rows.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "embedding")
    return rows.mapInArrow(lean(_coded(books, scale)), f"{kinds}, code string, error long")


def compress(rows: DataFrame, scale: int = 256, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of rows (vec_id, embedding, label)."""
    small_batches(rows.sparkSession)
    mine = kept(rows.select("vec_id", "embedding", "label"))
    books = fit(mine, "vec_id", scale, parts, entries, rounds)
    coded = stored(encode(mine, books, scale), "codes")
    # a label may have a third of all rows: summed before the shuffle, and the sums go to the rows
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    few = len(sums.limit(MOST_SENT + 1).select(F.lit(1)).toArrow()) <= MOST_SENT
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


def op12_ball_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _assigned(name: str, books: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT r, p, v, min(d * 64 + k) % 64 AS k, min(d * 64 + k) // 64 AS d FROM (
  SELECT parts.r, parts.p, parts.v, b.k, CAST(list_sum(list_transform(range(1, len(parts.v) + 1), lambda i: (parts.v[i] - b.c[i]) * (parts.v[i] - b.c[i]))) AS BIGINT) AS d
  FROM parts JOIN {books} b ON parts.p = b.p) GROUP BY r, p, v)"""


def _refined(name: str, old: str, assigned: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT o.p, o.k, coalesce(n.c, o.c) AS c FROM {old} o LEFT JOIN (
  SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT p, k, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, k, v, unnest(range(1, len(v) + 1)) AS i FROM {assigned}) GROUP BY p, k, i) GROUP BY p, k) n ON o.p = n.p AND o.k = n.k)"""


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)] AS v FROM (SELECT r, e, unnest(range(16)) AS p FROM kept)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, v AS c FROM parts WHERE r <= 64),
{_assigned("a1", "b0")},
{_refined("b1", "b0", "a1")},
{_assigned("a2", "b1")},
{_refined("b2", "b1", "a2")},
{_assigned("a3", "b2")},
coded AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a3 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN kept USING (r) CROSS JOIN books
"""
