"""Sequence packing by shortest-pack-first over the length histogram.

1. One pass over the texts tokenises them, whole, and cuts each document every `size` ids; pieces carry the checksum
   of their ids, so the texts aren't read again. A word's ids depend on the word alone (the tokenizer drops white
   space and merges within words), so a task keeps the ids of the words it has met.
2. Pieces of full size are sequences by themselves. Of the others only the histogram of lengths, fewer than `size`
   numbers, goes to the driver, which fills packs: lengths longest first, each into the open packs with the fewest
   tokens in which it fits, a new pack where it fits nowhere. Packs with the same content are one pattern with a count,
   so the work depends on the number of distinct lengths, not on the number of documents.
3. Every pattern holds ranks of pieces of each of its lengths. A piece's rank among those of its length comes from
   counts by (length, bucket) and a row number inside the bucket, so that no length has to fit in one task.

Texts: null and empty ones have the end id alone. Rows that repeat an id are packed one by one (start counts within
the row). An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkbasin.llm.common import lean, partitions_for, small_batches, stored, table

SIZE = 2048
END_ID = 1
_CACHED_WORDS = 300_000  # the cache of a worker process is emptied there; words met later are encoded again
_KEPT_WORDS = 100_000  # and after a task it keeps the words that it met first, which are the frequent ones


#: Words that normalising only lower-cases, as letters of one pre-token, with ASCII marks after them as another.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_characters() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    out, spare = [], 256
    for b in range(256):
        printable = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if printable else spare))
        spare += not printable
    return "".join(out)


_BYTE_CHARACTERS = _byte_characters()


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    Plain words go straight to the tokenizer's model, all others through its whole chain; both are kept for the next
    time. A tokenizer that doesn't encode word by word gets whole texts.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(map(re.escape, sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))) or r"(?!)")
        self.end = np.array([end_id], "<u4").tobytes()
        self.words: dict[bytes, bytes] = {}
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_word = encode("The cat, \t\nÉtat") == encode("the") + encode("cat") + encode(",") + encode("état")
        self.plain = self.by_word and all(encode(w) == self._model(w) for w in ("a", "the", "zebras", "qxqxz", "été"))

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, word: str) -> list[int]:
        return [x.id for x in self.tokenizer.model.tokenize(word.encode("utf-8").decode("latin-1").translate(_BYTE_CHARACTERS))]

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        plain = _PLAIN.fullmatch(text) if self.plain else None
        if not plain:
            return self._encode(text)
        letters, marks = plain.groups()
        letters = letters.lower()
        key = letters.encode("utf-8")
        out = self.words.get(key)  # met with other marks or capitals
        if out is None:
            out = self.words[key] = array("I", self._model(letters)).tobytes()
        return out + self._marks(marks) if marks else out

    def _marks(self, marks: str) -> bytes:
        key = marks.encode()
        if key not in self.words:
            self.words[key] = self._encode(marks)
        return self.words[key]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if not self.by_word or self.special.search(t):  # a special token may span words
                out.append(self._encode(t) + self.end)
                continue
            # bytes split at ASCII white space alone, which is what the tokenizer always drops
            words = t.encode("utf-8").lower().split()
            known = self.words
            for w in words:
                if w not in known:
                    if len(known) >= _CACHED_WORDS:
                        kept = {x: known[x] for x in words if x in known}
                        known.clear()
                        known.update(kept)
                    known[w] = self._word(w)
            out.append(b"".join(map(known.__getitem__, words)) + self.end)
        return out


_encoders: dict = {}


def _shrink(encoder: WordEncoder) -> None:
    encoder.words = dict(itertools.islice(encoder.words.items(), _KEPT_WORDS))


def _encoder(path: str, end_id: int) -> WordEncoder:
    """One for all tasks of a worker process."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def _pieces(path: str, size: int, end_id: int):
    @lean
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, end_id)
        try:
            yield from encoded(encoder, batches)
        finally:
            _shrink(encoder)

    def encoded(encoder: WordEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a in range(0, len(texts), 256):
                rows = []
                for i, raw in zip(ids[a : a + 256], encoder.encode(texts[a : a + 256])):
                    n = len(raw) // 4
                    rows += [(i, s, min(size, n - s), zlib.crc32(raw[4 * s : 4 * (s + size)]), n) for s in range(0, n, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return pieces


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns (pieces as (length, how many), in the order in which they lie) with their counts."""
    packs: dict[tuple, int] = {}
    open_: list[tuple[int, tuple]] = []  # (tokens in the pack, pattern)

    def put(pattern: tuple, used: int, count: int) -> None:
        if pattern not in packs:
            heappush(open_, (used, pattern))
        packs[pattern] = packs.get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            used, pattern = open_[0] if open_ else (size, ())
            if used + length > size:
                each = size // length  # new packs take as many as the shortest-pack rule would add one by one
                packs_new = max(1, left // each)
                times = min(each, left)
                put(((length, times),), times * length, packs_new)
                left -= packs_new * times
                continue
            heappop(open_)
            have = packs.pop(pattern)
            # the shortest packs all get one piece more before any gets a second, as they stay the shortest no longer
            take = min(have, left)
            body, (last, times) = pattern[:-1], pattern[-1]
            longer = (*body, (last, times + 1)) if last == length else (*pattern, (length, 1))
            if have > take:
                put(pattern, used, have - take)
            put(longer, used + length, take)
            left -= take
    return sorted(packs.items())


def _slots(histogram: dict[int, int], size: int, first: int):
    """For each length, ranks' upper ends with the sequence of the lowest rank and the offset; the sequences used."""
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    taken = dict.fromkeys(histogram, 0)
    for pattern, count in shortest_pack_first(histogram, size):
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                slots.setdefault(length, []).append((taken[length], first, offset, count))
                taken[length] += count
                offset += length
        first += count
    assert taken == histogram
    return slots, first


def _place(slots: dict):
    tables = {k: np.array(v, np.int64) for k, v in slots.items()}

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own, t = np.flatnonzero(length == n), tables[int(n)]
                at = np.searchsorted(t[:, 0], rank[own], "right") - 1
                sequence[own], offset[own] = t[at, 1] + rank[own] - t[at, 0], t[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return place


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, bucket_rows: int = 1 << 17) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs (doc_id, text)."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    small_batches(spark)
    cut = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer_path, size, end_id), schema), "pack-pieces")
    n_pieces = cut.count()
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(partitions_for(n_pieces, bucket_rows)))
    rows = cut.withColumn("bucket", bucket)
    counts = rows.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside).cast("long") - 1).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("base")).alias("rank"))
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    full = histogram.pop(size, 0)
    slots, _ = _slots(histogram, size, full)
    if full:
        slots[size] = [(0, 0, 0, full)]
    return ranked.mapInArrow(_place(slots), schema + ", sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
