"""Slides and the frames of a recording that show them: an interval join by time, scored by tags, text and nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkbasin.functions.arrays import jaccard
from inkbasin.functions.text import words


def within(left: DataFrame, right: DataFrame, by: str, at: str, before: float, after: float) -> DataFrame:
    """Pairs of rows of one `by` whose right time lies from `before` seconds ahead of the left time to `after` behind it.

    Times (at) are seconds as doubles; columns of the right side get the prefix r_. Time is cut in buckets as long as the
    interval: a left row goes to the two that its interval meets at most, so the join is one of equal keys, which is split
    where a key has very many rows, and its output is what lies within. Rows without a time have no partner.
    """
    width = F.lit(float(before + after) or 1.0)
    bucket = lambda t: F.floor(t / width).cast("long")
    begins, ends = F.col(at) - before, F.col(at) + after
    dealt = left.withColumn("_bucket", F.explode(F.sequence(bucket(begins), bucket(ends))))
    other = right.select(F.col(by), bucket(F.col(at)).alias("_bucket"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c != by))
    return dealt.join(other, [by, "_bucket"]).filter((F.col(f"r_{at}") >= begins) & (F.col(f"r_{at}") <= ends)).drop("_bucket")


def nearest(left: DataFrame, right: DataFrame, by: str, at: str, before: float, after: float, n: int, ties: str) -> DataFrame:
    """Pairs as of `within`, but of each left row only those with the n nearest right rows, ties by the smallest `ties`.

    Other pairs are never made, however many lie within: work and output grow with the rows of both sides. A left row
    goes to the bucket of its time, a right row to those whose left rows it may reach (two, seldom three). A bucket is
    sorted by time, and a left row takes the n right rows on either side of it. Of right rows of one time only n can
    count. A bucket of one key is one task's, so its rows are what a task must sort, on disk if need be.
    """
    span = abs(before) + abs(after)
    width = F.lit(float(before + after) or 1.0)
    bucket = lambda t: F.floor(t / width).cast("long")
    known = F.col(by).isNotNull() & F.col(at).isNotNull()
    other = [c for c in right.columns if c != by]
    same = right.filter(known).withColumn("_nth", F.row_number().over(Window.partitionBy(by, at).orderBy(ties))).filter(F.col("_nth") <= n)
    rows = F.array_sort(F.collect_list(F.struct("_nth", *other)), lambda a, b: a["_nth"] - b["_nth"])
    slack = (F.abs(at) + span) * 1e-14  # bounds are rounded otherwise than those of the filter
    reached = F.explode(F.sequence(bucket(F.col(at) - after - slack), bucket(F.col(at) + before + slack)))
    times = same.groupBy(by, at).agg(rows.alias("_rows")).select(by, reached.alias("_bucket"), F.col(at).alias("_t"), "_rows")

    begins, ends = F.col(at) - before, F.col(at) + after
    place = F.least(F.greatest(F.col(at), begins), ends)  # the time of the interval that is nearest to the row's own
    asked = left.filter(known).select(F.col(by), bucket(F.col(at)).alias("_bucket"), place.alias("_t"), F.struct(*left.columns).alias("_left"))
    both = asked.unionByName(times, allowMissingColumns=True)

    asks = F.col("_left").isNotNull()
    apart = Window.partitionBy(by, "_bucket").orderBy(asks, "_t")  # times first, then those who ask
    up_to, later = F.collect_list("_rows").over(apart.rowsBetween(1 - n, 0)), F.collect_list("_rows").over(apart.rowsBetween(1, n))
    both = both.withColumn("_around", F.when(~asks, F.struct(F.slice(F.flatten(F.reverse(up_to)), 1, n).alias("behind"), F.slice(F.flatten(later), 1, n).alias("ahead"))))
    both = both.withColumn("_first", F.first("_around").over(apart))
    mixed = Window.partitionBy(by, "_bucket").orderBy("_t", asks)
    both = both.withColumn("_around", F.coalesce(F.last("_around", ignorenulls=True).over(mixed), "_first")).filter(asks)

    found = both.select("_left.*", F.concat("_around.behind", "_around.ahead").alias("_found"))
    inside = F.filter("_found", lambda r: (r[at] >= begins) & (r[at] <= ends))
    ranked = found.withColumn("_found", inside).withColumn("_order", F.slice(F.array_sort(F.transform("_found", lambda r, i: F.struct(F.abs(F.col(at) - r[at]).alias("gap"), r[ties].alias("tie"), i.alias("i")))), 1, n))
    pairs = ranked.select(*left.columns, F.explode(F.transform("_order", lambda o: F.get("_found", o["i"]))).alias("_r"))
    return pairs.select(*left.columns, *(F.col(f"_r.{c}").alias(f"r_{c}") for c in other))


def nearest_frames(slides: DataFrame, frames: DataFrame, by: str = "recording", before: float = 5, after: float = 10, window: int = 3, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), divisor: float = 10) -> DataFrame:
    """slides (recording, slide, at, tags, text) with the frame (recording, frame, at, tags, text) that fits best, and its score.

    Of the frames within the interval the `window` nearest in time (ties by frame) are scored: shared tags and shared
    words, each as Jaccard, and 1 - distance / divisor, by their weights. Slides without a frame are kept.
    """
    near = nearest(slides, frames, by, "at", before, after, window, "frame").withColumn("_gap", F.abs(F.col("at") - F.col("r_at")))
    share = lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), jaccard(a, b)).otherwise(0.0)
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    parts: list[Column] = [share(some("tags"), some("r_tags")), share(words(F.lower("text")), words(F.lower("r_text"))), F.greatest(F.lit(0.0), 1 - F.col("_gap") / divisor)]
    score = sum((p * w for p, w in zip(parts, weights)), F.lit(0.0))
    # rows of one slide are one slide, so the nearest of all of them are scored
    first = Window.partitionBy(by, "slide").orderBy("_gap", "r_frame")
    near = near.select(by, "slide", "_gap", "r_frame", score.alias("_score")).withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= window)
    best = near.groupBy(by, "slide").agg(F.max_by(F.struct("r_frame", "_score"), F.struct("_score", (-F.col("_place")).alias("p"))).alias("_b"))
    return slides.join(best, [by, "slide"], "left").select(*slides.columns, F.col("_b.r_frame").alias("frame"), F.col("_b._score").alias("score"))
