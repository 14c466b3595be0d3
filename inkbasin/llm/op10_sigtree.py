"""N-gram Jaccard join by signature trees.

Two documents link when their sets of 5-word shingles have a Jaccard similarity of at least 80 %. Results are exact
up to collisions of 64-bit hashes of shingles.

1. Classes. Documents with equal sets form a class; its smallest row stands for it. Only classes are compared.
2. Candidates. Linked sets share shingles among the smallest of each (in hash order): of a set of n, the first
   n - ceil(0.8 n) + l hold l common ones. With l = n / 20, a class of which fewer of these shingles occur elsewhere
   than any partner asks for can't link and is dropped. Tasks drop repeated (shingle, class) rows before the shuffle,
   and the reader of a shingle's rows streams over them. Only the texts of classes that are left are shuffled: a bitmap
   of 2^24 to 2^27 bits, which has the hashes of their rows and possibly some others, is broadcast for that.
3. Signature trees. Classes with a shingle in common meet in a cell, as bitmaps, by band of sizes (a partner's size is
   within 1.25, so a class is in the cells of two bands). There, a tree over them holds in each node the OR of the
   bitmaps below, the range of sizes and the largest number of shingles beyond one per bit. Two trees are walked
   together: a pair of nodes goes no further if the sizes are too far apart, if the largest possible overlap, bits in
   common plus the smaller excess, is too small for the sizes, or if all below are joined already. The texts of the
   pairs that remain are compared exactly. That takes two steps: bitmaps alone tell which members may link with one of
   another group, and only their texts come to the cell (to one of the cells that have the same of them), where groups grow as links are found, so that a large group of
   near copies costs about one comparison a member and no list of pairs ever leaves a cell. A cell of more than
   `cell_rows` members, `cell_bytes` of bitmaps or eight times as much of text is split into a grid, so that every pair
   of members still meets in one.
   First, each class is in the cells of its smallest shared shingle, then of the smallest by two other orders if other
   groups are there, which joins nearly all near copies to a group.
   Then classes that share enough with other groups are dealt anew. Shingles with the same members count as one, so that
   a passage that many share makes few cells. By rising number of members, a class that shares k shingles and needs t
   of them is in the cells of the first k - t + 1.
4. Connected components of the links found, without collecting any.

n_shingles counts the set. A text that is null or has no word has an empty set and links with nothing. Repeated rows
and equal or null ids are rows of their own (component_id is null only if every id of the component is). An empty table
gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkbasin.llm.common import dropped, free_names, lean, row_keys, runs_of, small_batches, stored, table
from inkbasin.llm.components import components
from inkbasin.llm.shingles import mixed, shingle_sets

FANOUT = 8
#: Bits of the bitmap of rows whose texts are needed: eight for each, between these two (32 MB of rows at most).
SIFT = 1 << 24, 1 << 27


def least_overlap(n: int) -> int:
    """Shingles that a set of n shares at least with any partner."""
    return -(-4 * n // 5)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, of sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if 5 * len(a) < 4 * len(b) or not len(a):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    place = np.arange(1, len(s) + 1, dtype=np.uint64)
    both = mixed(s + place * np.uint64(0x9E3779B97F4A7C15)).sum(), mixed(s ^ (place * np.uint64(0xC2B2AE3D27D4EB4F))).sum()
    return tuple(int(x.astype(np.int64)) for x in both)


def _raw_runs(batch: pa.RecordBatch, most: int = 4 << 20):
    """(row numbers, texts) of a batch, some MB at a time."""
    texts = batch.column("raw").to_pylist()
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size < most):
            size += len(texts[b] or b"")
            b += 1
        yield range(a, b), [t or b"" for t in texts[a:b]]
        a = b


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.asarray(x, np.uint64) for chunk in column.chunks for x in np.split(chunk.flatten().to_numpy().astype(np.uint64), np.cumsum(pc.list_value_length(chunk).to_numpy())[:-1])] if column.length() else []


@lean
def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid = batch.column("_rid")
        for rows, texts in _raw_runs(batch):
            sets = shingle_sets(texts)
            keys = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
            heads = [s[: len(s) - least_overlap(len(s)) + max(1, len(s) // 20)] for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([rid.slice(rows[0], len(rows)), sizes, pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists(heads)], names=["_rid", "n", "k1", "k2", "head"])


@lean
def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, class, whether it is within the l = 1 prefix), once for a class that the task meets again."""
    met: set[int] = set()
    for batch in batches:
        keys, sizes = batch.column("k1").to_pylist(), batch.column("n").to_pylist()
        heads = _arrays(pa.chunked_array([batch.column("head")]))
        new = [i for i, k in enumerate(keys) if len(heads[i]) and not (k in met or met.add(k))]
        if len(met) > 2_000_000:
            met.clear()
        for a in range(0, len(new), 512):
            part = new[a : a + 512]
            h = np.concatenate([heads[i] for i in part]).astype(np.int64)
            length = [len(heads[i]) for i in part]
            first = np.concatenate([np.arange(n) for n in length]) <= np.repeat([sizes[i] - least_overlap(sizes[i]) for i in part], length)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(np.array([keys[i] for i in part], np.int64), length)), pa.array(first)], names=["h", "k1", "first"])


@lean
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, sorted by (h, k1), of shingles that more than one class has; one row per class."""
    held = None  # the last row, of which it isn't known yet
    told = False  # whether its shingle is known to be shared
    for batch in batches:
        h, k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "k1", "first"))
        if held is not None:
            h, k, f = np.r_[held[0], h], np.r_[held[1], k], np.r_[held[2], f]
        new = np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])]
        h, k, f = h[new], k[new], f[new]
        if not len(h):
            continue
        like_before = np.r_[told, h[1:] == h[:-1]]
        keep = like_before.copy()
        keep[:-1] |= h[1:] == h[:-1]
        held, told = (h[-1:], k[-1:], f[-1:]), bool(like_before[-1])
        keep[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(k[keep]), pa.array(f[keep])], names=["h", "k1", "first"])
    if held is not None and told:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["h", "k1", "first"])


def band_of(n: int) -> int:
    """Sizes of partners lie in the same band or a neighbouring one."""
    return int(math.log(n) / math.log(1.25) + 1e-9)


def band_bits(band: int) -> int:
    """Bits of the bitmaps of a band: four to eight for each shingle."""
    return 1 << min(17, max(6, int(4 * 1.25 ** (band + 1)).bit_length()))


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, np.uint64)
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


@lean
def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and band of classes, their bitmaps for that band and the next, and the text."""
    for batch in batches:
        for rows, texts in _raw_runs(batch):
            sets = shingle_sets(texts)
            bands = [band_of(len(s)) for s in sets]
            maps = [pa.array([bitmap(s, band_bits(b + up)).tobytes() for s, b in zip(sets, bands)], pa.binary()) for up in (0, 1)]
            k1, raw = (batch.column(c).slice(rows[0], len(rows)) for c in ("k1", "raw"))
            # a cell holds texts as well: eight bytes of text count as one of a bitmap
            sizes = [max(len(up), len(text) // 8) for up, text in zip(maps[1].to_pylist(), texts)]
            yield pa.RecordBatch.from_arrays([k1, pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.int64()), pa.array(sizes, pa.int64()), *maps, raw], names=["k1", "n", "band", "bytes", "own", "up", "raw"])


class Forest:
    """Union-find over members."""

    def __init__(self, labels: np.ndarray):
        _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[inverse].tolist()

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


class SignatureTree:
    """Bitmaps, sizes and excess of members; levels of nodes above them."""

    def __init__(self, size: np.ndarray, maps: np.ndarray):
        self.size, self.map = size, maps
        self.excess = self.size - np.bitwise_count(self.map).sum(1)

    def build(self, order: np.ndarray, roots: np.ndarray) -> None:
        """Levels from the leaves up: (bitmap, least size, largest size, excess, least root, largest root)."""
        self.order = order
        level = (self.map[order], self.size[order], self.size[order], self.excess[order], roots[order], roots[order])
        self.levels = [level]
        while len(level[0]) > 1:
            cut = np.arange(0, len(level[0]), FANOUT)
            level = tuple(f.reduceat(x, cut, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum), level))
            self.levels.append(level)

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of the others may link with one."""
        both = np.bitwise_count(self.map[others] & self.map[one]).sum(1).astype(np.int64) + np.minimum(self.excess[others], self.excess[one])
        n, m = self.size[others], self.size[one]
        return (180 * np.minimum(both, np.minimum(n, m)) >= 80 * (n + m)) & (5 * n >= 4 * m) & (4 * n <= 5 * m)

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes may hold a pair that links and isn't joined."""
        bits, low, high, excess, first, last = self.levels[level]
        ok = (5 * high[a] >= 4 * low[b]) & (5 * high[b] >= 4 * low[a])
        ok &= ~((first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b]))
        at = np.flatnonzero(ok)
        for p in range(0, len(at), 4096):
            q = at[p : p + 4096]
            both = np.bitwise_count(bits[a[q]] & bits[b[q]]).sum(1).astype(np.int64) + np.minimum(excess[a[q]], excess[b[q]])
            both = np.minimum(both, np.minimum(high[a[q]], high[b[q]]))
            ok[q] = 180 * both >= 80 * (low[a[q]] + low[b[q]])
        return ok

    def pairs(self):
        """Pairs of members that remain, by dual traversal from the root with itself; some thousand at a time."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            ok = self.possible(level, a, b)
            a, b = a[ok], b[ok]
            if not level:
                keep = a < b
                yield self.order[a[keep]], self.order[b[keep]]
                continue
            n = len(self.levels[level - 1][0])
            x = (a[:, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
            y = (b[:, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
            keep = (x <= y) & (x < n) & (y < n)
            x, y = x[keep], y[keep]
            for p in range(0, len(x), 1 << 15):
                stack.append((level - 1, x[p : p + (1 << 15)], y[p : p + (1 << 15)]))


_CELL = ["key", "cell_band", "cell_i", "cell_j"]


def partnered(k: np.ndarray, label: np.ndarray, tree: SignatureTree) -> np.ndarray:
    """Which members the tree can't rule out for a member of another group.

    Some leaders are compared with all, as that settles large groups of near copies at once.
    """
    found = np.zeros(len(k), bool)
    todo, everyone = np.argsort(tree.size, kind="stable"), np.arange(len(k))
    for _ in range(8):
        if not len(todo):
            return found
        near = tree.near(todo[0], everyone) & (label != label[todo[0]])
        found |= near
        found[todo[0]] |= near.any()
        todo = todo[1:][~found[todo[1:]]]
    _, roots = np.unique(label, return_inverse=True)
    tree.build(np.lexsort((tree.size, roots)), roots.astype(np.int64))
    for a, b in tree.pairs():
        other = label[a] != label[b]
        found[a[other]] = found[b[other]] = True
    return found


@lean
def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, k1, label, n, map) sorted by cell: those with a possible partner of another group in the cell.

    They come with their number and a sum of their hashes, by which cells that are left with the same members are one.
    """
    held: list[pa.Table] = []
    size = 0
    for cell in runs_of(batches, *_CELL):
        if cell.num_rows < 2:
            continue
        if cell.num_rows == 2:
            keep = None if _pair(cell) else cell.slice(0, 0)
        else:
            k, label, n = (cell[c].to_numpy() for c in ("k1", "label", "n"))
            tree = SignatureTree(n.astype(np.int64), np.stack([np.frombuffer(m, "<u8") for m in cell["map"].to_pylist()]))
            keep = cell.filter(pa.array(partnered(k, label, tree)))
        part = (cell if keep is None else keep).select(["k1", "label"])
        if part.num_rows:
            sig = mixed(part["k1"].to_numpy().astype(np.uint64)).sum(keepdims=True).astype(np.int64)
            held.append(part.append_column("members", pa.array(np.full(part.num_rows, part.num_rows, np.int64))).append_column("sig", pa.array(np.repeat(sig, part.num_rows))))
            size += part.num_rows
        if size > 10_000:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _pair(cell: pa.Table) -> bool:
    """Whether the two members of a cell are of different groups and may link; the commonest cell."""
    (n, m), (x, y) = cell["n"].to_pylist(), (int.from_bytes(v, "little") for v in cell["map"].to_pylist())
    both = min((x & y).bit_count() + min(n - x.bit_count(), m - y.bit_count()), n, m)
    return cell["label"][0] != cell["label"][1] and 5 * n >= 4 * m and 5 * m >= 4 * n and 180 * both >= 80 * (n + m)


def join_cell(sets: list[np.ndarray], labels: np.ndarray) -> list[tuple[int, int]]:
    """Pairs that link, at most one less than there are members: with the labels they join all that links in the cell."""
    forest, out = Forest(labels), []
    if len(sets) < 2:
        return out
    size = np.array([len(s) for s in sets], np.int64)
    bits = 1 << min(15, max(6, int(4 * np.median(size)).bit_length()))
    tree = SignatureTree(size, np.stack([bitmap(x, bits) for x in sets]))

    def met(i: int, j: int) -> bool:
        if forest.find(i) == forest.find(j):
            return True
        if not linked(sets[i], sets[j]):
            return False
        forest.join(i, j)
        out.append((i, j))
        return True

    todo = np.argsort(size, kind="stable")
    for _ in range(32):  # stars: members that link with the first that is left join it
        if len(todo) < 2:
            break
        lead, todo = int(todo[0]), todo[1:]
        near = tree.near(lead, todo)
        joined = np.zeros(len(todo), bool)
        for at in np.flatnonzero(near).tolist():
            joined[at] = met(int(todo[at]), lead)
        todo = todo[~joined]
    roots = forest.roots()
    tree.build(np.lexsort((size, roots)), roots)
    for a, b in tree.pairs():
        for i, j in zip(a.tolist(), b.tolist()):
            met(i, j)
    return out


@lean
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (members, sig, k1, label, raw) sorted by (members, sig), the cells that are left: links (a, b) found there."""
    out: list[tuple[int, int]] = []
    for cell in runs_of(batches, "members", "sig"):
        k = cell["k1"].to_pylist()
        sets = [s for _, texts in _raw_runs(cell.combine_chunks().to_batches()[0]) for s in shingle_sets(texts)]
        out += [(max(k[i], k[j]), min(k[i], k[j])) for i, j in join_cell(sets, cell["label"].to_numpy())]
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])


def _cells(members: DataFrame, cell_rows: int, cell_bytes: int) -> DataFrame:
    """Members of keys and bands with several groups; those with too many members in a grid.

    members (key, k1, label, band, bytes of the bitmap): each is in its own band and the next. A member of part p of a
    split key goes to cells {p, j} for every j.
    """
    dealt = members.select("key", "k1", "label", "band", "bytes", F.explode(F.array("band", F.col("band") + 1)).alias("cell_band"))
    parts = F.greatest(F.ceil(F.count("*") / cell_rows), F.ceil(F.sum("bytes") / cell_bytes)).cast("long").alias("_parts")
    sizes = dealt.groupBy("key", "cell_band").agg(F.min("label").alias("low"), F.max("label").alias("high"), parts)
    sizes = sizes.filter("low <> high").select("key", "cell_band", "_parts")
    split = dealt.drop("bytes").join(sizes, ["key", "cell_band"])
    split = split.withColumn("_p", F.pmod(F.xxhash64("k1"), F.col("_parts"))).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    return split.withColumn("cell_i", F.least("_p", "_j")).withColumn("cell_j", F.greatest("_p", "_j")).drop("_parts", "_p", "_j")


def _sifted(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of raw (_rid) that are in wanted (rep), and a few others: what a bitmap of SIFT bits lets through."""
    bits = min(SIFT[1], max(SIFT[0], 1 << (8 * wanted.count()).bit_length()))
    bit = F.pmod(F.xxhash64("_rid"), F.lit(bits))
    marks = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(bits)).alias("_bit")).groupBy((F.col("_bit") / 64).cast("int").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_mask"))
    met = raw.withColumn("_bit", bit).withColumn("_word", (F.col("_bit") / 64).cast("int")).join(F.broadcast(marks), "_word")  # at most SIFT[1] / 64 rows of 12 bytes
    return met.filter("(_mask & shiftleft(1L, cast(_bit % 64 as int))) <> 0").select(*raw.columns)


def near_groups(spark: SparkSession, docs: DataFrame, cell_rows: int = 4096, cell_bytes: int = 4 << 20) -> DataFrame:
    """_rid, n, component (the smallest _rid of its group) of every row of docs (_rid, text)."""
    small_batches(spark)
    raw = docs.select("_rid", F.col("text").cast("binary").alias("raw"))
    heads = stored(raw.mapInArrow(_summaries, "_rid long, n long, k1 long, k2 long, head array<long>"), "jaccard-heads")
    rows = stored(heads.select("_rid", "n", "k1", "k2"), "jaccard-rows")
    classes = stored(rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("_rid").alias("rep"), F.first("n").alias("n")), "jaccard-classes")
    entries = heads.select("n", "k1", "head").mapInArrow(_entries, "h long, k1 long, first boolean")
    shared = entries.repartition("h").sortWithinPartitions("h", "k1").mapInArrow(_shared, "h long, k1 long, first boolean")
    shared = stored(shared, "jaccard-shared")
    dropped(heads)

    # one key for the first round and two more for the second: each is the least shingle under another order
    first = F.when(F.col("first"), F.col("h"))
    keys = [F.min(first).alias("key0"), *(F.min_by(first, F.when(F.col("first"), F.xxhash64("h", F.lit(r)))).alias(f"key{r}") for r in (1, 2))]
    found = shared.repartition("k1").groupBy("k1").agg(F.count("*").alias("met"), *keys)
    need = F.greatest(F.lit(1), F.expr("((4 * n + 4) div 5) div 20"))
    open_ = stored(found.join(classes, "k1").filter((F.col("met") >= need) & F.col("key0").isNotNull()).select("k1", "rep", "key0", "key1", "key2"), "jaccard-open")
    texts = _sifted(raw, open_).join(open_.select("k1", F.col("rep").alias("_rid")).hint("merge"), "_rid").select("k1", "raw")
    maps = stored(texts.mapInArrow(_maps, "k1 long, n long, band long, bytes long, own binary, up binary, raw binary"), "jaccard-maps")
    sized = maps.select("k1", "n", "band", "bytes")

    def compared(members: DataFrame, name: str) -> DataFrame:
        """Links (a, b) between classes that meet in cells of members (key, k1, label, band, bytes)."""
        lower = F.col("cell_band") > F.col("band")
        cells = _cells(members, cell_rows, cell_bytes).withColumn("lower", lower).join(maps.select("k1", "n", "own", "up").hint("merge"), "k1")
        cells = cells.select(*_CELL, "k1", "label", "n", F.when(F.col("lower"), F.col("up")).otherwise(F.col("own")).alias("map"))
        may = stored(cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(_may_link, "k1 long, label long, members long, sig long").distinct(), f"{name}-may")
        texts = may.join(maps.select("k1", "raw").hint("merge"), "k1").repartition("members", "sig").sortWithinPartitions("members", "sig", "k1")
        return stored(texts.mapInArrow(_links, "a long, b long").distinct(), name)

    label = F.col("k1").alias("label")
    near = compared(open_.select("k1", F.col("key0").alias("key")).join(sized, "k1").select("key", "k1", label, "band", "bytes"), "jaccard-first")
    # a class that was joined to another one takes its name; that needn't be the last name of its group yet
    named = near.groupBy("a").agg(F.min("b").alias("b"))
    second = open_.select("k1", F.explode(F.array("key1", "key2")).alias("key")).distinct().join(sized, "k1").join(named, F.col("k1") == F.col("a"), "left")
    near = near.unionAll(compared(second.select("key", "k1", F.coalesce("b", "k1").alias("label"), "band", "bytes"), "jaccard-second"))
    group = stored(components(near), "jaccard-groups")
    labels = stored(sized.join(group, sized["k1"] == group["node"], "left").select("k1", "n", "band", "bytes", F.coalesce("component", "k1").alias("label")), "jaccard-labels")

    # what is shared with another group only; classes with too little of that are done
    # number, signature and labels of all classes of a shingle come from a window, which Spark spills where it is large
    marks = shared.select("h", "k1").join(labels.select("k1", "label").hint("merge"), "k1")
    all_ = Window.partitionBy("h")
    marks = marks.select("k1", F.count("*").over(all_).alias("m"), F.bit_xor(F.xxhash64("k1")).over(all_).alias("sig"), F.min("label").over(all_).alias("low"), F.max("label").over(all_).alias("high"))
    marks = marks.filter("low <> high").select("k1", "m", "sig").repartition("k1")
    # shingles with the same members are one; of all that it shares, a class may miss need - 1 with a partner
    owned = marks.groupBy("k1", "m", "sig").agg(F.count("*").alias("w"))
    owned = owned.withColumn("before", F.sum("w").over(Window.partitionBy("k1").orderBy("m", "sig")) - F.col("w")).withColumn("all", F.sum("w").over(Window.partitionBy("k1")))
    chosen = owned.join(labels.hint("merge"), "k1").filter((F.col("all") >= need) & (F.col("before") <= F.col("all") - need))
    chosen = stored(chosen.select(F.xxhash64("m", "sig").alias("key"), "k1", "label", "band", "bytes"), "jaccard-chosen")
    more = compared(chosen, "jaccard-more")

    joined = stored(components(near.unionAll(more)), "jaccard-joined")
    dropped(shared, maps)
    # components speak of classes; a group is named by the smallest row of its classes
    named = classes.join(joined, classes["k1"] == joined["node"]).select("k1", "k2", "rep", F.col("component").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("least"))
    named = named.join(least, "c").select("k1", "k2", "least")
    out = rows.select("_rid", "n", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left").join(named, ["k1", "k2"], "left")
    return out.select("_rid", "n", F.coalesce("least", "rep", "_rid").alias("component"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one document of each group: that with the smallest id."""
    (rid,) = free_names(docs.columns, "_rid")
    keyed = row_keys(docs, name=rid)
    groups = near_groups(spark, keyed.select(F.col(rid).alias("_rid"), "text")).filter("_rid = component").select(F.col("_rid").alias(rid))
    return keyed.join(groups, rid, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def op10_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = row_keys(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = near_groups(spark, docs)
    ids = docs.select("_rid", "doc_id")
    out = found.join(ids, "_rid").join(ids.select(F.col("_rid").alias("component"), F.col("doc_id").alias("component_id")), "component")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component_id").cast("long").alias("component_id"))
