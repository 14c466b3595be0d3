"""Exact removal of repeated substrings: interval expansion on Burrows-Wheeler transforms.

Each byte goes that is covered by a string of `least` (100) bytes that also starts earlier: in a document with a smaller
id, or earlier in the same one. Strings never cross documents and are judged on the input.

1. Anchors. Of the 32-byte strings within a window of `least` bytes, that with the smallest hash is the window's anchor
   (the leftmost, if several). Equal windows have equal anchors at equal places, so windows are compared only where
   anchors agree. Neighbouring windows share an anchor: one row stands for them all, with the hash of the bytes that
   they span, its context. A task marks all but the first of equal contexts that it meets, so copies shrink before the
   shuffle; the reader of an anchor's rows streams over them and marks all but the first of equal contexts.
2. Interval expansion. Where an anchor has different contexts, their windows may still be equal in part. These contexts
   are joined to a text per bucket of anchors, its suffixes are sorted by their first `least` symbols and its
   Burrows-Wheeler transform is formed. From the interval of the empty string, backward extension, breadth first, finds
   the intervals of ever longer strings, and with them the longest common prefixes of neighbouring suffixes in order of
   increasing value. It stops at `least`: the neighbours left without a value share `least` symbols or more. Of every
   run of those, all but the earliest window are marked.
   The windows of an anchor with more than `most_contexts` contexts, such as a licence line in very many texts, are dealt
   by two hashes of their content instead: of equal ones a task sends the first and marks the others, so that a bucket
   meets a row for each task, and its first row stays unmarked.
3. The marks of a document are joined to its text once.

Hashes have 64 bits. A null text is an empty one. Rows with equal ids count in the order of their texts, null ids last;
repeated rows are copies like others. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbasin.llm.common import lean, lean_group, partitions_for, row_keys, small_batches, stored, table
from inkbasin.llm.shingles import _BYTE, mixed, powers

ANCHOR = 32
_RUN = 4 << 20
_TOP = np.uint64(0xFFFFFFFFFF000000)
_SYMBOL = np.random.default_rng(7).permutation(_BYTE)  # one number per byte value, upper and lower case apart
_SYMBOL_2 = np.random.default_rng(8).permutation(_BYTE)
#: Of a window that is dealt by its content.
WINDOW_BYTES = 48


def _slices(batch: pa.RecordBatch, least: int):
    """(row's id, offset, bytes) in groups of about _RUN bytes; very long texts in overlapping slices."""
    group, size = [], 0
    for rid, raw in zip(batch.column("_rid").to_pylist(), batch.column("raw").to_pylist()):
        raw = raw or b""
        for at in range(0, max(1, len(raw) - least + 1), _RUN):
            part = raw[at : at + _RUN + least - 1]
            if len(part) >= least:
                group.append((rid, at, part))
                size += len(part)
            if size >= _RUN:
                yield group
                group, size = [], 0
    if group:
        yield group


def anchors(group: list, least: int) -> dict[str, np.ndarray]:
    """Rows h, ctx, rid, lo, n: windows lo .. lo + n - 1 of a row have the anchor with hash h and span bytes hashed in ctx."""
    text = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
    lengths = np.array([len(x[2]) for x in group], np.int64)
    starts = np.cumsum(lengths) - lengths
    up, down = powers(len(text) + 1)
    run = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_SYMBOL[text] * up[: len(text)], out=run[1:])
    n = len(text) - ANCHOR + 1
    hashes = mixed((run[ANCHOR:] - run[:n]) * down[:n])
    low = (hashes & _TOP) | np.arange(n, dtype=np.uint64)
    width, span = least - ANCHOR + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low & ~_TOP).astype(np.int64)  # of the anchor of the window that starts here
    valid = np.repeat(lengths, lengths)[: len(place)] - (np.arange(len(place)) - np.repeat(starts, lengths)[: len(place)]) >= least
    at = np.flatnonzero(valid)
    cut = np.flatnonzero(np.r_[True, (place[at][1:] != place[at][:-1]) | (np.diff(at) != 1)]) if len(at) else at
    first, count = at[cut], np.diff(np.r_[cut, len(at)])
    anchor = place[first]
    end = first + count + least - 1
    ctx = mixed((run[end] - run[first]) * down[first] + ((end - first) * 4096 + anchor - first).astype(np.uint64))
    owner = np.searchsorted(starts, first, "right") - 1
    rid, offset = (np.array([x[i] for x in group], np.int64)[owner] for i in (0, 1))
    return {"h": hashes[anchor].astype(np.int64), "ctx": ctx.astype(np.int64), "rid": rid, "lo": first - starts[owner] + offset, "n": count}


def _merged(rid: np.ndarray, lo: np.ndarray, n: np.ndarray):
    """Runs of windows with those that touch or overlap as one; sorted by row."""
    order = np.lexsort((lo, rid))
    rid, lo, hi = rid[order], lo[order], (lo + n)[order]
    if not len(rid):
        return rid, lo, n
    own = np.cumsum(np.r_[0, rid[1:] != rid[:-1]])
    base = own * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + base)
    new = np.r_[True, (lo + base)[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return rid[at], lo[at], (reach - base)[np.r_[at[1:] - 1, len(rid) - 1]] - lo[at]


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


_ROW = ["mark", "h", "ctx", "rid", "lo", "n"]


def _anchor_rows(least: int):
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _slices(batch, least):
                a = anchors(group, least)
                order = np.lexsort((a["lo"], a["rid"], a["ctx"], a["h"]))
                h, ctx, rid, lo, n = (a[c][order] for c in _ROW[1:])
                new = np.r_[True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])] if len(h) else np.zeros(0, bool)
                yield _batch(_ROW, np.zeros(int(new.sum()), bool), *(c[new] for c in (h, ctx, rid, lo, n)))
                r, a_lo, a_n = _merged(rid[~new], lo[~new], n[~new])
                yield _batch(_ROW, np.ones(len(r), bool), r, np.zeros(len(r), np.int64), r, a_lo, a_n)

    return rows


@lean
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mark, h, ctx, rid, lo). Marks, and the first of each context of an anchor that has several."""
    names = ["h", "rid", "lo", "n"]
    held, told = None, False
    for batch in batches:
        mark = batch.column("mark").to_numpy(zero_copy_only=False)
        h, ctx, rid, lo, n = (batch.column(c).to_numpy()[~mark] for c in _ROW[1:])
        yield _batch(names, pa.nulls(int(mark.sum()), pa.int64()), *(batch.column(c).to_numpy()[mark] for c in names[1:]))
        if held is not None:
            h, ctx, rid, lo, n = (np.r_[a, b] for a, b in zip(held, (h, ctx, rid, lo, n)))
        if not len(h):
            continue
        new = np.r_[True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])]
        r, a, b = _merged(rid[~new], lo[~new], n[~new])
        yield _batch(names, pa.nulls(len(r), pa.int64()), r, a, b)
        h, ctx, rid, lo, n = (x[new] for x in (h, ctx, rid, lo, n))
        keep = like = np.r_[told, h[1:] == h[:-1]]
        keep = like.copy()
        keep[:-1] |= h[1:] == h[:-1]
        held, told = tuple(x[-1:] for x in (h, ctx, rid, lo, n)), bool(like[-1])
        keep[-1] = False
        yield _batch(names, *(x[keep] for x in (h, rid, lo, n)))
    if held is not None and told:
        yield _batch(names, *(held[i] for i in (0, 2, 3, 4)))


#: What a row is that goes to a bucket: a context with its bytes, the first of equal windows that a task has met, windows that start earlier elsewhere.
CONTEXT, WINDOW, MARK = 0, 1, 2
_DEALT = ["kind", "bucket", "rid", "lo", "n", "w1", "w2", "raw"]
DEALT = "kind int, bucket long, rid long, lo long, n long, w1 long, w2 long, raw binary"
#: Windows that a task remembers, of those that it met twice and of others, about 200 bytes each; beyond, it begins anew.
MOST_SEEN = 1 << 18


def _dealt(kind: int, bucket, rid, lo, n=None, w1=None, w2=None, raw=None) -> pa.RecordBatch:
    rows = len(rid)
    null = lambda t: pa.nulls(rows, t)
    columns = [pa.array(x) if x is not None else null(pa.int64()) for x in (bucket, rid, lo, n, w1, w2)]
    return _batch(_DEALT, pa.array(np.full(rows, kind, np.int32)), *columns, null(pa.binary()) if raw is None else pa.array(raw, pa.binary()))


def windows(strings: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """Of every window of some strings: its string, its offset there and two hashes of its bytes."""
    text = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(lengths) - lengths
    up, down = powers(len(text) + 1)
    count = (lengths - least + 1).clip(0)
    owner = np.repeat(np.arange(len(strings)), count)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = starts[owner] + offset
    hashes = []
    for symbol in (_SYMBOL, _SYMBOL_2):
        run = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(symbol[text] * up[: len(text)], out=run[1:])
        hashes.append(mixed((run[at + least] - run[at]) * down[at]).astype(np.int64))
    return owner, offset, *hashes


def _contexts(least: int, buckets: int):
    """Contexts with their bytes, dealt to buckets by anchor; those of anchors with very many as windows, by content.

    Of equal windows a task sends the first and marks the others; one that is frequent is remembered over batches, so
    that a bucket gets a row for each task of it and not for each document.
    """

    @lean
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, int]] = {}  # met twice
        once: dict[tuple[int, int], tuple[int, int]] = {}
        for batch in batches:
            cold: list = []
            rids, los, parts = [], [], []
            for raw, rid, own in zip(batch.column("raw").to_pylist(), batch.column("rid").to_pylist(), batch.column("own").to_pylist()):
                for c in own:
                    part = raw[c["lo"] : c["lo"] + c["n"] + least - 1]
                    if c["hot"]:
                        rids.append(rid)
                        los.append(c["lo"])
                        parts.append(part)
                    else:
                        cold.append((c["h"] % buckets, rid, c["lo"], part))
            for a in range(0, len(cold), 20_000):
                bucket, rid, lo, raw = zip(*cold[a : a + 20_000])
                yield _dealt(CONTEXT, np.array(bucket), np.array(rid), np.array(lo), raw=raw)
            for a in range(0, len(parts), 20_000):
                yield from _hot(np.array(rids[a : a + 20_000]), np.array(los[a : a + 20_000]), parts[a : a + 20_000], seen, once)

    def _hot(rids: np.ndarray, los: np.ndarray, parts: list[bytes], seen: dict, once: dict):
        owner, offset, w1, w2 = windows(parts, least)
        rid, lo = rids[owner], los[owner] + offset
        order = np.lexsort((lo, rid, w2, w1))
        rid, lo, w1, w2 = (x[order] for x in (rid, lo, w1, w2))
        new = np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])] if len(rid) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        again = np.diff(np.r_[at, len(rid)]) > 1
        mark = ~new
        for i, frequent in zip(at.tolist(), again.tolist()):
            key, place = (int(w1[i]), int(w2[i])), (int(rid[i]), int(lo[i]))
            first = seen.get(key) or once.pop(key, None)
            if first is not None and first < place:
                mark[i] = True
                place = first
            to = seen if first is not None or frequent else once
            if len(to) >= MOST_SEEN:
                to.clear()
            to[key] = place
        keep = ~mark
        yield _dealt(WINDOW, (w1[keep].astype(np.uint64) % np.uint64(buckets)).astype(np.int64), rid[keep], lo[keep], w1=w1[keep], w2=w2[keep])
        r, start, n = _merged(rid[mark], lo[mark], np.ones(int(mark.sum()), np.int64))
        yield _dealt(MARK, r % buckets, r, start, n)

    return contexts


def suffix_order(text: np.ndarray, least: int) -> np.ndarray:
    """Suffixes (of the text as a circle) sorted by their first `least` symbols at least, by doubling."""
    key = np.zeros(len(text), np.uint64)
    for j in range(7):
        key = key << np.uint64(9) | np.roll(text, -j).astype(np.uint64)
    length = 7
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.zeros(len(text), np.uint64)
        rank[order] = np.cumsum(np.r_[0, sorted_[1:] != sorted_[:-1]]).astype(np.uint64)
        if length >= least:
            return order
        key = rank << np.uint64(32) | np.roll(rank, -length)
        length *= 2


def common_prefixes(transform: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order whether it shares `least` symbols with the one before it, from the transform alone."""
    n = len(transform)
    by_symbol = np.argsort(transform, kind="stable")
    back = np.empty(n, np.int64)  # where the suffix that is one symbol longer stands
    back[by_symbol] = np.arange(n)
    known = np.zeros(n + 1, bool)  # the common prefix of suffixes i - 1 and i has been met: it is shorter than `least`
    known[[0, n]] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1, np.int64)
    for _ in range(least):
        if not len(low):
            break
        size = high - low + 1
        one = size == 1
        new_low = new_high = back[low[one]]
        many = np.flatnonzero(~one)
        if len(many):
            of = np.repeat(np.arange(len(many)), size[many])
            at = np.arange(len(of)) - np.repeat(np.cumsum(size[many]) - size[many], size[many]) + low[many][of]
            key = of * 512 + transform[at]
            order = np.argsort(key, kind="stable")
            key, to = key[order], back[at[order]]
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            new_low = np.r_[new_low, to[cut]]
            new_high = np.r_[new_high, to[np.r_[cut[1:] - 1, len(to) - 1]]]
        fresh = ~known[new_high + 1]
        low, high = new_low[fresh], new_high[fresh]
        known[high + 1] = True
    return ~known[:n]


def repeated_windows(strings: list[bytes], least: int) -> np.ndarray:
    """(string, offset) of the windows that equal an earlier one, strings in the order of their places."""
    text = np.zeros(sum(map(len, strings)) + len(strings) + 1, np.uint16)
    lengths = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    joined = np.frombuffer(b"\0" + b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16)
    text[:] = joined + 1
    text[np.r_[0, starts + lengths]] = 0
    order = suffix_order(text, least)
    same = common_prefixes(text[order - 1], least)
    cut = np.flatnonzero(~same)
    run = np.cumsum(~same) - 1
    owner = np.searchsorted(starts, order, "right") - 1
    inside = (owner >= 0) & (order + least <= (starts + lengths)[owner]) & (text[order] > 0)
    earliest = np.minimum.reduceat(order, cut)
    again = inside & (order != earliest[run])
    at, own = order[again], owner[again]
    return np.stack([own, at - starts[own]], 1)


def _expand(least: int):
    @lean_group
    def expand(bucket: pa.Table) -> pa.Table:
        kind = bucket["kind"].to_numpy()
        of = lambda k: bucket.filter(pa.array(kind == k))
        rows = of(CONTEXT).sort_by([("rid", "ascending"), ("lo", "ascending")])
        rid, lo = rows["rid"].to_numpy(), rows["lo"].to_numpy()
        found = repeated_windows(rows["raw"].to_pylist(), least) if len(rid) else np.zeros((0, 2), np.int64)
        hot = of(WINDOW)
        r, a, w1, w2 = (hot[c].to_numpy() for c in ("rid", "lo", "w1", "w2"))
        order = np.lexsort((a, r, w2, w1))
        later = order[1:][(w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])]
        r, a = np.r_[rid[found[:, 0]], r[later]], np.r_[lo[found[:, 0]] + found[:, 1], a[later]]
        r, a, n = _merged(r, a, np.ones(len(r), np.int64))
        told = of(MARK)
        return pa.table({c: np.r_[x, told[c].to_numpy()] for c, x in (("rid", r), ("lo", a), ("n", n))})

    return expand


def removed(marks: list, length: int, least: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the marked windows (lo, n) cover."""
    out: list[tuple[int, int]] = []
    for lo, n in sorted(marks):
        end = min(length, lo + n + least - 1)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((lo, end))
    return out


def repeated_bytes(spark: SparkSession, docs: DataFrame, least: int = 100, most_contexts: int = 4096, bucket_bytes: int = 1 << 19) -> DataFrame:
    """rid, lo, n: runs of windows of docs (_rid, text) that start earlier elsewhere; runs of a row may overlap."""
    assert least >= ANCHOR + 1
    small_batches(spark)
    raw = docs.select("_rid", F.col("text").cast("binary").alias("raw"))
    rows = raw.mapInArrow(_anchor_rows(least), "mark boolean, h long, ctx long, rid long, lo long, n long")
    judged = rows.repartition("h").sortWithinPartitions("mark", "h", "ctx", "rid", "lo").mapInArrow(_compare, "h long, rid long, lo long, n long")
    judged = stored(judged, "repeats-judged")
    open_ = judged.filter("h is not null")
    many = open_.groupBy("h").agg(F.count("*").alias("k"), F.sum("n").alias("n")).withColumn("hot", F.col("k") > most_contexts)
    size = many.agg(F.sum(F.when(F.col("hot"), F.col("n") * WINDOW_BYTES).otherwise(F.col("n") + F.col("k") * least))).first()[0]
    hot = many.filter("hot").select("h", "hot")
    own = open_.join(hot, "h", "left").groupBy("rid").agg(F.collect_list(F.struct("h", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("own"))
    texts = raw.join(own, raw["_rid"] == own["rid"]).select("rid", "raw", "own")
    contexts = texts.mapInArrow(_contexts(least, partitions_for(size, bucket_bytes)), DEALT)
    more = contexts.groupBy("bucket").applyInArrow(_expand(least), "rid long, lo long, n long")
    return judged.filter("h is null").select("rid", "lo", "n").unionAll(stored(more, "repeats-expanded"))


def _cut(least: int):
    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("_rid").to_pylist(), []
            for rid, raw, marks in zip(ids, batch.column("raw").to_pylist(), batch.column("marks").to_pylist()):
                raw = raw or b""
                runs = removed([(m["lo"], m["n"]) for m in marks or ()], len(raw), least)
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((rid, len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            if out:
                yield _batch(["_rid", "n_bytes", "n_removed", "n_spans", "kept_sha256"], *(pa.array(x) for x in zip(*out)))

    return cut


def op9_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = row_keys(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return digests(spark, docs)


def digests(spark: SparkSession, docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text, _rid)."""
    marks = repeated_bytes(spark, docs, least).groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))
    raw = docs.select("_rid", F.col("text").cast("binary").alias("raw"))
    found = raw.join(marks, raw["_rid"] == marks["rid"], "left").select("_rid", "raw", "marks")
    found = found.mapInArrow(_cut(least), "_rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.join(docs.select("_rid", "doc_id"), "_rid").select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
