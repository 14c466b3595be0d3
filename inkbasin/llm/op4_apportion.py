"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Targets. Sources in code point order (null last) weigh 5, 2, 1, repeating, and share `share` (150%) of all words;
   a target stops at `most` (2) times its source's words and the excess goes to the others by weight, until none is
   above.
2. Blocks. Seats of `block` words are dealt to the sources by the highest quotients of Sainte-Lague, votes being the
   targets. The documents of a source fall into shards of about `shard_words` words by a hash; the source's seats go
   to its shards in the same way, votes being the shards' words: an integer quota per shard.
3. Selection. A shard's documents lie one after another in seeded order and are cut into blocks of `block` words. With
   quota q and n blocks, every block is taken q div n times, and q mod n seeded ones, spread evenly from a seeded
   start, once more. A document's words are those of its part of each block, so it never gives over `most` times its
   words. The last block of a shard may be short.

What a document gives follows from its place in the shard in closed form; blocks are never materialised. The driver
holds one row per source; the shards of a source meet in one task as (shard, words, blocks).

Null or empty texts have size 0 and give nothing; a null source is a source of its own. Repeated rows and null ids are
rows of their own. An empty table gives an empty result; other columns don't matter, whatever their names. Reruns agree, as every hash is
seeded and every order total (rows that agree in id and text are alike).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heapify, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkbasin.llm.common import WORD, free_names, stored, table

WEIGHTS = (5, 2, 1)
#: The plan of at most so many sources is broadcast; more are joined.
MOST_SENT = 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """The target of each source, in the order of sizes."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [Fraction(0)] * len(sizes)
    free, left = set(range(len(sizes))), share * sum(sizes)
    while free:
        each = left / sum(weight[i] for i in free)
        above = [i for i in free if each * weight[i] > most * sizes[i]]
        for i in above or free:
            out[i] = Fraction(most * sizes[i]) if above else each * weight[i]
        left -= sum(out[i] for i in above)
        free = free.difference(above) if above else set()
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients vote / (2 s + 1); ties to the smaller index; none over its most."""
    votes = np.asarray(votes, np.float64)
    most = np.full(len(votes), np.iinfo(np.int64).max) if most is None else np.asarray(most, np.int64)
    if not len(votes) or votes.sum() <= 0:
        return np.zeros(len(votes), np.int64)
    seats = min(seats, int(np.where(votes > 0, np.minimum(most, seats), 0).sum()))
    won = lambda divisor: np.minimum(np.ceil(votes / divisor - 0.5).clip(0), most).astype(np.int64)
    low, high = votes.sum() / (seats + len(votes) + 1.0) / 4, votes.max() * 4  # seats won at low >= seats >= at high
    while won(low).sum() < seats:
        low /= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if won(middle).sum() >= seats else (low, middle)
    got = won(high)
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and got[i] < most[i]]
    heapify(heap)
    for _ in range(seats - int(got.sum())):  # those that tie at the divisor, and no more
        _, i = heap[0]
        got[i] += 1
        heapreplace(heap, (-votes[i] / (2 * got[i] + 1) if got[i] < most[i] else 0.0, i))
    return got


def _quotas(block: int, most: int):
    def quotas(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("shard")
        blocks = -(-shards["shard_size"] // block)
        quota = sainte_lague(shards["shard_size"].to_numpy(), int(shards["seats"].iloc[0]), most * blocks.to_numpy())
        return pd.DataFrame({"s": shards["s"], "shard": shards["shard"], "blocks": blocks, "quota": quota})

    return quotas


def planned(docs: DataFrame, block: int, shard_words: int, seed: int, most: int):
    """docs (columns doc_id, text, source) with size, the source's and the shard's numbers and the place in the shard.

    Adds s (the source, null as its own key), source_size, target, shard, start, blocks, quota, turn; drops text.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"))
    sized = stored(sized.withColumn("s", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))), "mix-sizes")
    totals = sorted((r[0], r[1]) for r in sized.groupBy("s").agg(F.sum("size")).collect())
    goal = targets([n for _, n in totals], most=most)
    seats = sainte_lague(np.array([float(g) for g in goal]), round(sum(goal) / block))
    plan = [(s, n, float(g), int(k), max(1, -(-n // shard_words))) for (s, n), g, k in zip(totals, goal, seats)]
    small = len(plan) <= MOST_SENT
    plan = spark.createDataFrame(plan, "s string, source_size long, target double, seats long, shards long")
    # a source may hold a third of all rows
    rows = sized.join(F.broadcast(plan) if small else plan, "s").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "draw"), F.col("shards")))
    shards = rows.groupBy("s", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    quotas = shards.groupBy("s").applyInPandas(_quotas(block, most), "s string, shard long, blocks long, quota long")
    order = Window.partitionBy("s", "shard").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0))).join(quotas, ["s", "shard"])
    turn = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "s", "shard"), F.greatest("blocks", F.lit(1)))).otherwise(0)
    return placed.withColumn("turn", turn)


def _words_taken(block: int) -> str:
    """Words before a place in the shard that the extra blocks take: block k is extra if floor((k + turn + 1) e / n) steps up."""
    steps = "((({k}) + turn) * (quota % blocks) div blocks)"
    whole = lambda k: f"({steps.format(k=k)} - {steps.format(k='0')})"
    at = lambda x: f"({x} div {block})"
    before = lambda x: f"({whole(at(x))} * {block} + ({whole(at(x) + ' + 1')} - {whole(at(x))}) * ({x} % {block}))"
    return f"CASE WHEN size = 0 OR blocks = 0 THEN 0 ELSE (quota div blocks) * size + {before('(start + size)')} - {before('start')} END"


def mix(docs: DataFrame, block: int = 16, shard_words: int = 1 << 20, seed: int = 17, most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every row of docs (doc_id, text, source)."""
    rows = planned(docs, block, shard_words, seed, most)
    return rows.select("doc_id", "size", "source_size", "target", F.expr(_words_taken(block)).cast("long").alias("taken"), "source")


def _cut(block: int, text: str, numbers: list[str]):
    """The text that a document gives: whole copies first, then the words of its extra blocks as they stand."""
    import re

    word = re.compile(WORD)

    def give(text: str, start: int, copies: int, extra: int, blocks: int, turn: int) -> str:
        parts = [text] * copies
        if extra:
            spans = [m.span() for m in word.finditer(text)]
            k = start // block
            while k * block < start + len(spans):
                if (k + turn + 1) * extra // blocks > (k + turn) * extra // blocks:
                    a, b = max(0, k * block - start), min(len(spans), (k + 1) * block - start)
                    parts.append(text[spans[a][0] : spans[b - 1][1]])
                k += 1
        return "\n".join(parts)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["text"] = [give(*x) for x in zip(rows.pop(text), *(rows.pop(n) for n in numbers))]
            yield rows

    return cut


def mixed_documents(spark: SparkSession, docs: DataFrame, block: int = 16, shard_words: int = 1 << 20, seed: int = 17, most: int = 2) -> DataFrame:
    """The documents of the mix with the columns of docs: text is what the mix takes of a document, repeats included.

    A document that gives nothing is left out; n_chars, if there, is counted anew.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    # rows that agree in id and text lie side by side in one shard; their parts differ, so they are told apart by number
    same = Window.partitionBy("doc_id", "draw").orderBy("start")
    rows = planned(docs.select("doc_id", "text", "source"), block, shard_words, seed, most).withColumn("nth", F.row_number().over(same)).withColumn("taken", F.expr(_words_taken(block)))
    id_, draw, nth, text, *numbers = names = free_names(docs.columns, "_id", "_draw", "_nth", "_text", "_start", "_copies", "_extra", "_blocks", "_turn")
    of = (F.col("start"), F.expr("quota div blocks"), F.expr("quota % blocks"), F.col("blocks"), F.col("turn"))
    rows = rows.filter("taken > 0").select(F.col("doc_id").alias(id_), F.col("draw").alias(draw), F.col("nth").alias(nth), *(c.alias(n) for c, n in zip(of, numbers)))
    mine, turn = free_names([*docs.columns, *names], "_own_draw", "_own_nth")
    texts = docs.withColumn(mine, key)
    texts = texts.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", mine).orderBy("doc_id")))
    joined = texts.join(rows, texts["doc_id"].eqNullSafe(rows[id_]) & (texts[mine] == rows[draw]) & (texts[turn] == rows[nth]))
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "text string"])
    out = joined.select(*(texts[f"`{c}`"] for c in others), F.col("text").alias(text), *numbers).mapInPandas(_cut(block, text, numbers), schema)
    return out.select(*(F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def op4_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
