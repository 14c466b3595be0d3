"""Spelling variants: words one edit apart, each word's form, and the root that its forms lead to.

Words are counted by Spark: every run of letters of every whole text, some of them with a letter deleted by the contract's
rule, combined before they are shuffled. Two words are near if one inserted, deleted or replaced code point makes one of
the other: for some position their prefixes before it and their suffixes after it agree. With the words in forward order
a prefix is an interval, in reverse order a suffix is one, and the words that have both are the points of a rectangle,
reported by a wavelet tree over the reverse ranks in forward order.

A word of c letters is paired with words of c letters (replaced) and of c + 1 (inserted), which is class c; it is also the
longer word of class c - 1. Pairs of a class whose edit lies at half of c or behind it share the first half, others the
rest: words meet in the cells of these two keys, so that each pair is found once and no task needs the whole vocabulary.
A cell beyond `most` letters is dealt anew, a cell for each edit position, whose words differ at that position alone, so
it holds one word for each letter at most. A word of very many letters that such a cell holds is sent once for each of
its positions.

Null and empty texts have no words. Repeated documents count as often as they occur; a null doc_id is the empty text in
the hash. Ties go to the smaller word in code-point order. No words: no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbasin.llm.common import dropped, id_text, lean, partitions_for, small_batches, stored, table

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Searches that descend the tree together.
TOGETHER = 1 << 19
#: Words that are searched together, unless a cell has more.
CELLS = 1 << 16
#: Large cells whose keys are broadcast; beyond, they are joined by shuffle.
MOST_SENT = 100_000
WHOLE, REPLACED, INSERTED = 0, 1, 2
KEY = ["kind", "c", "first", "last", "cell"]


def words(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """word, n of docs (doc_id, text): runs of letters as the contract changes them, long and frequent enough."""
    runs = docs.select(id_text().alias("d"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("w"))
    low = runs.select("d", F.translate("w", UPPER, LOWER).alias("w"))
    hashed = low.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "w"))).withColumn("at", (F.col("h") % F.length("w")).cast("int"))
    cut = F.concat(F.expr("left(w, at)"), F.expr("substring(w, at + 2)"))
    made = hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("w")).alias("word"))
    return made.filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class WaveletTree:
    """Points (i, order[i]) of a permutation; reports those of rectangles."""

    def __init__(self, order: np.ndarray):
        self.n = len(order)
        self.levels: list[np.ndarray] = []
        self.bits = max(1, int(self.n - 1).bit_length())
        values = order
        for k in range(self.bits - 1, -1, -1):
            one = (values >> k) & 1
            self.levels.append(np.r_[0, np.cumsum(1 - one)])
            values = np.r_[values[one == 0], values[one == 1]]

    def report(self, a, b, low, high) -> tuple[np.ndarray, np.ndarray]:
        """Of rectangles [a, b) x [low, high): the index of the rectangle and the second coordinate of every point in it."""
        q, value = np.arange(len(a)), np.zeros(len(a), np.int64)
        for level, k in zip(self.levels, range(self.bits - 1, -1, -1)):
            za, zb, zeros = level[a], level[b], level[-1]
            q = np.r_[q, q]
            a, b = np.r_[za, zeros + a - za], np.r_[zb, zeros + b - zb]
            value = np.r_[value, value + (1 << k)]
            keep = (a < b) & (value < high[q]) & (value + (1 << k) > low[q])
            q, a, b, value = q[keep], a[keep], b[keep], value[keep]
        return q, value


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of letters (0 behind the end) in their order, and how many letters each shares with the one before it."""
    width = rows.shape[1]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    placed = rows[order]
    same = (placed[1:] == placed[:-1]) & (placed[1:] > 0)
    return order, np.r_[0, np.where(same.all(1), width, same.argmin(1))] if len(rows) > 1 else np.zeros(len(rows), np.int64)


def _interval(shared: np.ndarray, ranks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each rank the interval of rows that have the same first letters, `length` of them."""
    starts = np.flatnonzero(np.r_[True, shared[1:] < length])
    at = np.searchsorted(starts, ranks, "right") - 1
    return starts[at], np.r_[starts, len(shared)][at + 1]


def pairs(letters: np.ndarray, lengths: np.ndarray, kind: int, c: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of words of c letters (unless kind is INSERTED), and of c and c + 1 (unless it is REPLACED), whose edit lies at a position from first to before last.

    letters: distinct words, one a row of c + 1 columns, 0 behind the end. A pair of equal lengths comes in both
    directions, one of different lengths once, the shorter word first.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for longer in {WHOLE: (False, True), REPLACED: (False,), INSERTED: (True,)}[kind]:
        mine = np.arange(len(lengths)) if longer else np.flatnonzero(lengths == c)
        if len(mine) < 2 or longer and (lengths == c).all():
            continue
        rows, size = letters[mine], lengths[mine]
        forward, shared = _order(rows)
        turned = np.zeros_like(rows)
        for n in np.unique(size):
            turned[size == n, :n] = rows[size == n, :n][:, ::-1]
        backward, shared_back = _order(turned)
        rank, rank_back = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
        rank[forward], rank_back[backward] = np.arange(len(mine)), np.arange(len(mine))
        tree = WaveletTree(rank_back[forward])
        ask = np.flatnonzero(size == c)
        for i in range(first, min(last, c + longer)):
            a, b = _interval(shared, rank[ask], i)
            low, high = _interval(shared_back, rank_back[ask], c - i - (not longer))
            open_ = (b - a > 1) & (high - low > 1)
            for part in np.array_split(np.flatnonzero(open_), max(1, -(-int(open_.sum()) // TOGETHER))):
                q, value = tree.report(a[part], b[part], low[part], high[part])
                s, t = ask[part[q]], backward[value]
                # an inserted letter of a run of equal ones counts at its last place
                keep = (size[t] == c + 1) & ((i == c) | (rows[t, i] != rows[s, min(i, c - 1)])) if longer else s != t
                found.append((mine[s[keep]], mine[t[keep]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _near(batches):
    """word, near, near_n of the cells of a task, sorted by KEY; cells of one kind are searched together, about `CELLS` words or one cell."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in KEY], 1)
        edges = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            now = tuple(keys[a].tolist())
            if held and (now[:-1] != last[:-1] or now != last and sum(x.num_rows for x in held) >= CELLS):
                yield from _searched(held, *last[:-1])
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield from _searched(held, *last[:-1])


def _searched(held: list[pa.RecordBatch], kind: int, c: int, first: int, last: int):
    rows = pa.Table.from_batches(held).combine_chunks()
    text, n = rows["word"].combine_chunks(), rows["n"].to_numpy()
    lengths = np.asarray(pc.utf8_length(text), np.int64)
    if (lengths == c).sum() == 0 or len(lengths) < 2:
        return
    flat = np.frombuffer("".join(text.to_pylist()).encode("latin-1"), np.uint8)
    letters = np.zeros((len(lengths), c + 1), np.uint8)
    letters[np.arange(c + 1) < lengths[:, None]] = flat
    s, t = pairs(letters, lengths, kind, c, first, last)
    other = lengths[t] != lengths[s]
    a, b = np.r_[s, t[other]], np.r_[t, s[other]]
    for i in range(0, len(a), 1 << 16):
        x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([text.take(pa.array(x)), text.take(pa.array(y)), pa.array(n[y])], names=["word", "near", "near_n"])


def _cells(vocabulary: DataFrame, least_length: int) -> DataFrame:
    """Each word (word, n) in the two cells of each of its two classes, with the positions to search there."""
    classes = vocabulary.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("c")).filter(F.col("c") >= least_length)
    front = F.struct(F.col("half").alias("first"), (F.col("c") + 1).alias("last"), F.expr("left(word, half)").alias("key"))
    back = F.struct(F.lit(0).alias("first"), F.col("half").alias("last"), F.expr("right(word, c - half)").alias("key"))
    halves = classes.withColumn("half", F.expr("c div 2").cast("int")).select("word", "n", "c", F.explode(F.array(front, back)).alias("k"))
    return halves.select("word", "n", F.lit(WHOLE).alias("kind"), "c", "k.first", "k.last", F.xxhash64("c", "k.first", "k.key").alias("cell"))


def _dealt(cells: DataFrame) -> DataFrame:
    """The same rows position by position: words of a cell are equal but for a letter put in (INSERTED) or another letter (REPLACED) there."""
    at = cells.select("word", "n", "c", F.explode(F.sequence("first", F.col("last") - 1)).alias("first"))
    left, out, kept = F.expr("left(word, first)"), F.expr("substring(word, first + 2)"), F.expr("substring(word, first + 1)")
    cell = lambda kind, rest: F.struct(F.lit(kind).alias("kind"), F.xxhash64("c", "first", F.lit(kind), left, rest).alias("cell"))
    own = F.length("word") == F.col("c")
    to = F.when(own & (F.col("first") < F.col("c")), F.array(cell(REPLACED, out), cell(INSERTED, kept))).when(own, F.array(cell(INSERTED, kept))).otherwise(F.array(cell(INSERTED, out)))
    return at.withColumn("to", F.explode(to)).select("word", "n", "to.kind", "c", "first", (F.col("first") + 1).alias("last"), "to.cell")


def near(vocabulary: DataFrame, least_length: int = 5, most: int = 1 << 20, each: int = 1 << 17) -> DataFrame:
    """word, near, near_n: every pair of near words of vocabulary (word, n; distinct words, stored), in both directions.

    most: letters of a cell that goes to a task whole (a cell of 512 words always does); each: rows of a task, about.
    """
    small_batches(vocabulary.sparkSession)
    cells = _cells(vocabulary, least_length)
    sums = cells.groupBy("cell").agg(F.sum(F.length("word")).alias("letters"), F.count("*").alias("rows"))
    # cells of over `most` letters: 8 bytes for each million letters of the vocabulary
    large = sums.filter((F.col("letters") > most) & (F.col("rows") > 512)).select("cell")
    n = len(large.limit(MOST_SENT + 1).toArrow())
    if n:
        large = stored(large, "variant-cells")
        large = F.broadcast(large) if n <= MOST_SENT else large
        cells = cells.join(large, "cell", "left_anti").select(*cells.columns).unionAll(_dealt(cells.join(large, "cell", "left_semi").select(*cells.columns)))
    tasks = partitions_for(4 * vocabulary.count(), each)
    return cells.repartition(tasks, "cell").sortWithinPartitions(*KEY).select("word", "n", *KEY).mapInArrow(lean(_near), "word string, near string, near_n long")


def roots(links: DataFrame) -> DataFrame:
    """word, root of links (word, form): the end of the chain of forms, in as many rounds as the logarithm of the longest."""
    now = stored(links.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("end"))
        then = stored(now.join(further, "root", "left").select("word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "variant-roots")
        dropped(now)
        now = then.select("word", "root")
        if not then.filter("moved").take(1):
            return now


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of docs (doc_id, text)."""
    vocabulary = stored(words(docs.select("doc_id", "text"), least_length, least_count, every), "variant-words")
    best = near(vocabulary, least_length).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    enough = -F.col("best.m") >= times * F.col("n")
    formed = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.w")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n"))
    formed = stored(formed, "variant-forms")
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
