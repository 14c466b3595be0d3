"""LM scoring by context-tree weighting.

Every byte is eight binary decisions. A decision's context is the bits of the byte so far and up to `depth` bytes
before it; each context holds a Krichevsky-Trofimov estimate, and the weighting mixes the estimates of all depths. A
context that training never reached predicts one half.
The weights depend on counts alone, not on the order of the text, so the tree is a batch computation:

1. A task cuts its rows into blocks of about `block_bytes` and stores them with the block's distinct (context, byte)
   grams and words and their counts: for each block one row of packed keys per bucket. Grams with the same two nearest
   context bytes are whole subtrees and share a bucket; words, for the base score, go the same way by a 63-bit hash.
2. The rows of a bucket stream through one task, which sums the counts. Subtrees are weighted from the leaves up, some
   ten thousand grams at a time. Depths 0 and 1 have at most 65,280 decision nodes together with their sums, so these
   alone go to the driver and back.
3. The rows of a bucket stream through a task once more, after the bucket's sums: each distinct gram gets its log
   probability once, and every block gets the values of its own grams and words back.

Nothing that grows with the corpus is broadcast or collected, and no task holds more than a block or the distinct keys
of a bucket. There are at most `most_buckets` buckets, so that rows don't grow with the square of the blocks.

Texts: null is the empty text. Every text ends in an end symbol, byte 0xFF, which UTF-8 never uses; before its start
stand `depth` such bytes. Rows with equal or null ids are scored one by one; a null id counts as the empty text for
the choice of held-out rows. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbasin.llm.common import id_text, lean, lean_groups, partitions_for, small_batches, stored, table
from inkbasin.llm.grams import KeyTable
from inkbasin.llm.shingles import mixed, word_hashes

END = 0xFF
GRAM, WORD = 0, 1  # kinds of keys
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 19
_BATCH = 1 << 20
_SLICE = 1 << 16  # grams that are weighted at once, and more only if they share two context bytes
_LN2 = math.log(2)
_HALF = np.array([math.lgamma(i / 2) if i else 0.0 for i in range(64)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of multiples of one half, from 1/2 on."""
    big = np.maximum(x, 16.0)
    series = (big - 0.5) * np.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big**3) + 1 / (1260 * big**5)
    return np.where(x < 32, _HALF[np.minimum(2 * x, 63).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - 2 * _HALF[1] - _lgamma(zeros + ones + 1.0)


def _sums(sorted_ids: np.ndarray, *values: np.ndarray):
    first = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]]) if len(sorted_ids) else np.zeros(0, np.int64)
    return sorted_ids[first], *(np.add.reduceat(v, first) if len(first) else v for v in values)


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def _nodes(keys: np.ndarray, counts: np.ndarray, below, bit: int):
    """The decision nodes of one depth and bit: ids, zeros, total, own weight, log of the weighted probability."""
    one = ((keys >> _u(7 - bit)) & _u(1)).astype(np.float64)
    ids, ones, total = _sums(keys >> _u(8 - bit), counts * one, counts)
    own = log_kt(total - ones, ones)
    if below is None:
        return ids, total - ones, total, np.ones(len(ids)), own
    child, _, _, _, weighted = below
    split = np.bincount(np.searchsorted(ids, _parent(child, bit)), weights=weighted, minlength=len(ids))
    mixed = np.logaddexp(own, split) - _LN2
    return ids, total - ones, total, np.exp(own - _LN2 - mixed), mixed


def _parent(child: np.ndarray, bit: int) -> np.ndarray:
    return ((child >> _u(bit + 8)) << _u(bit)) | (child & _u((1 << bit) - 1))


def weigh(grams: np.ndarray, counts: np.ndarray, depth: int, least: int) -> dict:
    """Nodes of depths `depth` to `least` by (depth, bit). A gram is the context's nearest byte first, then the byte."""
    order = np.argsort(grams)
    keys, counts = grams[order], counts[order].astype(np.float64)
    out: dict = {}
    for d in range(depth, least - 1, -1):
        for bit in range(8):
            out[d, bit] = _nodes(keys, counts, out.get((d + 1, bit)), bit)
        shorter = ((keys >> _u(16)) << _u(8)) | (keys & _u(255))
        order = np.argsort(shorter)
        keys, counts = _sums(shorter[order], counts[order])
    return out


def weigh_top(rows: list) -> dict:
    """Nodes of depths 1 and 0 from (bit, id, zeros, ones, sum of the weighted logs below)."""
    out: dict = {}
    for bit in range(8):
        own = sorted((r[1:] for r in rows if r[0] == bit))
        ids = np.array([r[0] for r in own], np.uint64)
        zeros, ones, split = (np.array([r[i] for r in own], np.float64) for i in (1, 2, 3))
        kt = log_kt(zeros, ones)
        mixed = np.logaddexp(kt, split) - _LN2
        out[1, bit] = ids, zeros, zeros + ones, np.exp(kt - _LN2 - mixed), mixed
        up = _parent(ids, bit)
        order = np.argsort(up, kind="stable")
        root, z, o, s = _sums(up[order], zeros[order], ones[order], mixed[order])
        kt = log_kt(z, o)
        mixed = np.logaddexp(kt, s) - _LN2
        out[0, bit] = root, z, z + o, np.exp(kt - _LN2 - mixed), mixed
    return out


def log10_probability(grams: np.ndarray, nodes: dict, depth: int) -> np.ndarray:
    """Of each gram's byte after its context: the mixture over all depths, bit by bit."""
    total = np.zeros(len(grams))
    for bit in range(8):
        value = ((grams >> _u(7 - bit)) & _u(1)).astype(bool)
        p = np.full(len(grams), 0.5)
        for d in range(depth, -1, -1):
            ids, zeros, count, own, _ = nodes[d, bit]
            if not len(ids):
                continue
            want = ((grams >> _u(8 * (depth - d) + 8)) << _u(bit)) | ((grams & _u(255)) >> _u(8 - bit))
            at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
            kt = (np.where(value, count[at] - zeros[at], zeros[at]) + 0.5) / (count[at] + 1)
            p = np.where(ids[at] == want, own[at] * kt + (1 - own[at]) * p, p)
        total += np.log10(p)
    return total


def _joined(texts: list, depth: int):
    """All texts in one buffer, each after `depth` end bytes and followed by one; where each starts, its length."""
    pad = bytes([END]) * depth
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = depth + np.concatenate([[0], np.cumsum(lengths + depth + 1)[:-1]]).astype(np.int64) if len(texts) else lengths
    buffer = np.frombuffer(pad + (bytes([END]) + pad).join(texts) + bytes([END]), np.uint8)
    return buffer, starts, lengths


def _batches(column: pa.ChunkedArray, mask: np.ndarray):
    """(indexes, lower-cased texts) of the rows where mask holds, some MB at a time."""
    rows = np.flatnonzero(mask)
    size = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy()[rows].astype(np.int64) + 1)
    for group in np.split(rows, np.flatnonzero(np.diff(size // _BATCH)) + 1):
        if len(group):
            yield group, [(t or b"").translate(_LOWER) for t in column.take(pa.array(group)).to_pylist()]


def _pieces(buffer: np.ndarray, depth: int):
    """(first position, grams) of stretches of the buffer, which bounds what is held at once."""
    for a in range(depth, len(buffer), _STEP):
        b = min(len(buffer), a + _STEP)
        part = buffer[a - depth : b].astype(np.uint64)
        n = b - a
        grams = part[depth:].copy()
        for back in range(1, depth + 1):
            grams |= part[depth - back : depth - back + n] << _u(8 * (depth + 1 - back))
        yield a, grams


def _scored(a: int, n: int, starts: np.ndarray, lengths: np.ndarray):
    """The documents that a stretch of n positions from a meets: indexes, and from where to where in it."""
    lo = np.searchsorted(starts + lengths, a, "left")
    hi = np.searchsorted(starts, a + n, "left")
    d = np.arange(lo, hi)
    return d, np.maximum(starts[d] - a, 0), np.minimum(starts[d] + lengths[d] + 1 - a, n)


def _words(texts: list[bytes]):
    """63-bit hashes of the words of texts, and how many each text has."""
    h, counts = word_hashes(texts)
    return h >> _u(1), counts


def pack(values: np.ndarray) -> bytes:
    """8-byte values, byte by byte of their places, compressed."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int, kind: type) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys, by their differences."""
    return pack(np.diff(keys, prepend=_u(0)))


def unpack_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(raw, n, np.uint64), dtype=np.uint64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, with the sums of their counts."""
    keys, counts = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in ((0, np.uint64), (1, np.int64)))
    order = np.argsort(keys, kind="stable")
    return _sums(keys[order], counts[order])


class _Counted:
    """Keys with counts; what comes in is summed up whenever it has doubled."""

    def __init__(self):
        self.parts, self.size, self.least = [], 0, 1 << 18

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > self.least:
            self.parts = [_summed(self.parts)]
            self.size = len(self.parts[0][0])
            self.least = 2 * self.size + (1 << 18)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(self.parts)


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in order, in tables of about `most` bytes of text (column raw); a longer text is a table with its neighbours."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("raw")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        a = 0
        while a < len(ends):
            before = int(ends[a - 1]) if a else 0
            b = min(len(ends), int(np.searchsorted(ends, before + most - size, "left")) + 1)
            held.append(batch.slice(a, b - a))
            size += int(ends[b - 1]) - before
            a = b
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _distinct(texts: list[bytes], depth: int, train: bool, grams: _Counted, words: _Counted) -> None:
    buffer, starts, _ = _joined(texts, depth)
    scored = np.ones(len(buffer), bool)
    scored[(starts[:, None] - 1 - np.arange(depth)).ravel()] = False
    for a, g in _pieces(buffer, depth):
        keys, n = np.unique(g[scored[a : a + len(g)]], return_counts=True)
        grams.add(keys, n if train else np.zeros(len(keys), np.int64))
    keys, n = np.unique(_words(texts)[0], return_counts=True)
    words.add(keys, n if train else np.zeros(len(keys), np.int64))


def bucket_of(kind: int, keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """Grams by their two nearest context bytes, words by themselves."""
    return (mixed(keys >> _u(8 * (depth - 1)) if kind == GRAM else keys) % _u(buckets)).astype(np.int32)


_COUNTS = "block long, doc_id long, held_out boolean, raw binary, kind byte, bucket int, size int, keys binary, counts binary"


def _count(depth: int, block_bytes: int, buckets: int):
    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, block in enumerate(blocks(batches, block_bytes), first):
            held = block["held_out"].to_numpy()
            grams, words = _Counted(), _Counted()
            for train in (True, False):
                for _, texts in _batches(block["raw"], held != train):
                    _distinct(texts, depth, train, grams, words)
            out: list[tuple] = []
            for kind, counted in ((GRAM, grams), (WORD, words)):
                keys, counts = counted.all()
                bucket = bucket_of(kind, keys, depth, buckets)
                order = np.argsort(bucket, kind="stable")
                at = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for k in np.flatnonzero(np.diff(at)).tolist():
                    own = order[at[k] : at[k + 1]]
                    out.append((kind, k, len(own), pack_keys(keys[own]), pack(counts[own])))
            for text in block.to_batches():
                yield _row_batch(text.num_rows, number, text.column("doc_id"), text.column("held_out"), text.column("raw"))
            for a in range(0, len(out), 256):
                part = out[a : a + 256]
                yield _row_batch(len(part), number, *(pa.nulls(len(part), t) for t in (pa.int64(), pa.bool_(), pa.binary())), *(pa.array(c, t) for c, t in zip(zip(*part), (pa.int8(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))))

    return count


def _row_batch(n: int, number: int, doc_id, held_out, raw, *keys) -> pa.RecordBatch:
    keys = keys or tuple(pa.nulls(n, t) for t in (pa.int8(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))
    names = ["block", "doc_id", "held_out", "raw", "kind", "bucket", "size", "keys", "counts"]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int64)), doc_id, held_out, raw, *keys], names=names)


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _cuts(kind: int, keys: np.ndarray, depth: int) -> list[int]:
    """Where to cut ascending keys into slices of about _SLICE, whole subtrees each."""
    at, out = 0, [0]
    while at < len(keys):
        at = min(len(keys), at + _SLICE)
        if at < len(keys) and kind == GRAM:
            at = int(np.searchsorted(keys, ((keys[at - 1] >> _u(8 * (depth - 1))) + _u(1)) << _u(8 * (depth - 1))))
        out.append(at)
    return out


_SUMS = "kind byte, bucket int, part int, size int, total long, known long, keys binary, counts binary"


def _sum_buckets(depth: int):
    @lean
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (kind, bucket)."""
        for (kind, bucket), rows in itertools.groupby(_rows(batches, "kind", "bucket", "size", "keys", "counts"), lambda r: r[:2]):
            counted = _Counted()
            for _, _, n, keys, counts in rows:
                counted.add(unpack_keys(keys, n), unpack(counts, n, np.int64))
            keys, counts = counted.all()
            cuts = _cuts(kind, keys, depth)
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                row = (kind, bucket, part, b - a, int(counts[a:b].sum()), int((counts[a:b] > 0).sum()), pack_keys(keys[a:b]), pack(counts[a:b]))
                types = (pa.int8(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=["kind", "bucket", "part", "size", "total", "known", "keys", "counts"])

    return sums


def _top_sums(depth: int):
    @lean
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, keys, counts in _rows(batches, "size", "keys", "counts"):
            grams, counts = unpack_keys(keys, n), unpack(counts, n, np.int64)
            nodes = weigh(grams[counts > 0], counts[counts > 0], depth, 2)
            out = []
            for bit in range(8):
                ids, zeros, total, _, mixed_ = nodes[2, bit]
                up = _parent(ids, bit)
                order = np.argsort(up, kind="stable")
                one, z, o, s = _sums(up[order], zeros[order], (total - zeros)[order], mixed_[order])
                out.append((np.full(len(one), bit, np.int32), one.astype(np.int64), z, o, s))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(5)], names=["bit", "node", "zeros", "ones", "below"])

    return sums


def _values(depth: int, top, whole: float):
    def of(kind: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if kind == WORD:
            return np.log10((counts + 0.1) / whole)
        seen = counts > 0
        return log10_probability(keys, weigh(keys[seen], counts[seen], depth, 2) | top.value, depth)

    @lean
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (kind, bucket, block, part); a bucket's sums come before its blocks, as block -1."""
        rows = _rows(batches, "kind", "bucket", "block", "size", "keys", "counts")
        for (kind, _), bucket in itertools.groupby(rows, lambda r: r[:2]):
            known: list[tuple[np.ndarray, np.ndarray]] = []
            keys = value = None
            out: list[tuple] = []
            for _, _, block, n, packed, counts in bucket:
                own = unpack_keys(packed, n)
                if block < 0:
                    known.append((own, of(kind, own, unpack(counts, n, np.int64))))
                    continue
                if keys is None:
                    keys, value = (np.concatenate([x[i] for x in known]) for i in (0, 1))
                    known.clear()
                out.append((block, kind, n, packed, pack(value[np.searchsorted(keys, own)])))
                if len(out) == 256:
                    yield _value_batch(out)
                    out = []
            if out:
                yield _value_batch(out)

    return values


def _value_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int8(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["block", "kind", "size", "keys", "value"])


def _score_block(depth: int, end_base: float, end_known: bool, unknown: float):
    @lean_groups
    def score(docs: pa.Table, values: pa.Table) -> pa.Table:
        tables = []
        for k in (GRAM, WORD):
            seen, logs = KeyTable(18), [np.zeros(1)]
            for kind, n, keys, value in _rows(values.to_batches(), "kind", "size", "keys", "value"):
                if kind == k:
                    seen.add(unpack_keys(keys, n))
                    logs.append(unpack(value, n, np.float64))
            tables.append((seen, np.concatenate(logs)))
        (grams, logp), (words, base) = tables
        n = docs.num_rows
        total, base_score = np.zeros(n), np.full(n, end_base)
        n_tokens, n_known, size = np.ones(n, np.int64), np.full(n, end_known, np.int64), np.zeros(n, np.int64)
        for rows, texts in _batches(docs["raw"], np.ones(n, bool)):
            buffer, starts, size[rows] = _joined(texts, depth)
            for a, g in _pieces(buffer, depth):
                run = np.r_[0.0, np.cumsum(logp[grams.find(g)])]
                d, lo, hi = _scored(a, len(g), starts, size[rows])
                total[rows[d]] += run[hi] - run[lo]
            hashes, counts = _words(texts)
            found, of = base[words.find(hashes)], np.repeat(np.arange(len(texts)), counts)
            n_tokens[rows] += counts
            n_known[rows] += np.bincount(of, weights=found > unknown, minlength=len(texts)).astype(np.int64)
            base_score[rows] += np.bincount(of, weights=found, minlength=len(texts))
        bits = -math.log2(10) * total / np.maximum(size, 1)
        return pa.table({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": n_tokens, "n_known": n_known, "base_score": base_score, "score": total, "bits_per_byte": bits})

    return score


def ctw_score(spark: SparkSession, docs: DataFrame, depth: int = 5, block_bytes: int = 16 << 20, most_buckets: int = 2048, held_out=None) -> DataFrame:
    """Score every text of docs (doc_id, text) under a tree learned from the rows that aren't held out.

    held_out: a boolean Column; by default crc32 of the id as text, modulo 10, is 0. Returns doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score (log10 probability of the lower-cased text with its end) and
    bits_per_byte.
    """
    assert 2 <= depth <= 6, "a gram has to fit in fewer than 64 bits"
    small_batches(spark)
    held_out = F.crc32(id_text()) % 10 == 0 if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("binary").alias("raw"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("raw"), F.lit(0)))).first()[0]
    buckets = min(most_buckets, max(64, partitions_for(size, 8 << 20)))
    found = stored(rows.mapInArrow(_count(depth, block_bytes, buckets), _COUNTS), "ctw-blocks")
    texts, keyed = found.filter("kind is null"), found.filter("kind is not null")
    sums = keyed.select("kind", "bucket", "size", "keys", "counts").repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    sums = stored(sums.mapInArrow(_sum_buckets(depth), _SUMS), "ctw-sums")
    n_docs = texts.filter("not held_out").count()
    n_words, distinct = sums.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    train = n_words + n_docs
    whole = train + 0.1 * (distinct + (n_docs > 0) + 1)

    below = sums.filter(F.col("kind") == GRAM).select("size", "keys", "counts").mapInArrow(_top_sums(depth), "bit int, node long, zeros double, ones double, below double")
    top = weigh_top([(r.bit, r.node, r.zeros, r.ones, r.below) for r in below.groupBy("bit", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).collect()])
    sent = spark.sparkContext.broadcast(top)
    columns = ["kind", "bucket", "block", "part", "size", "keys", "counts"]
    both = sums.withColumn("block", F.lit(-1).cast("long")).select(columns).unionAll(keyed.withColumn("part", F.lit(0)).withColumn("counts", F.lit(None).cast("binary")).select(columns))
    both = both.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "block", "part")
    values = both.mapInArrow(_values(depth, sent, whole), "block long, kind byte, size int, keys binary, value binary")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"
    score = _score_block(depth, math.log10((n_docs + 0.1) / whole), n_docs > 0, math.log10(0.5 / whole))
    result = texts.select("block", "doc_id", "held_out", "raw").groupBy("block").cogroup(values.groupBy("block")).applyInArrow(score, out)
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op1_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_score(spark, table(spark, sf_dir, "documents"))
