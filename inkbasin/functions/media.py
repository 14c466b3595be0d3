"""What adapters return about media files, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkbasin.functions.classify import text_quality

PROBE = "format struct<duration:string>, streams array<struct<codec_type:string,codec_name:string,width:string,height:string>>"


def probe_metadata(json: Column) -> Column:
    """Whole seconds, codec and WxH of the first video stream in the JSON of a media probe; nulls if it can't be read."""
    probe = F.from_json(json, PROBE)
    given = F.nullif(probe["format"]["duration"], F.lit(""))
    seconds = given.try_cast("double")
    readable = given.isNull() | (seconds.isNotNull() & ~F.isnan(seconds))
    video = F.get(F.filter(probe["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    sized = ~video["width"].isin("", "0") & ~video["height"].isin("", "0")
    return F.struct(
        F.when(readable, F.bround(seconds).cast("long")).alias("duration_seconds"),
        F.when(readable, video["codec_name"]).alias("codec"),
        F.when(readable & sized, F.concat(video["width"], F.lit("x"), video["height"])).alias("resolution"),
    )


def paged_text(pages: Column) -> Column:
    """Pages as one text under their numbers; an unreadable (null) page is empty and makes a good text partial."""
    text = F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("[PAGE "), (i + 1).cast("string"), F.lit("]\n"), F.coalesce(p, F.lit("")))), "\n\n")
    quality = text_quality(F.length(text), F.size(pages))
    lost = F.exists(pages, lambda p: p.isNull())
    return F.struct(text.alias("text"), F.length(text).alias("chars"), F.size(pages).alias("pages"), F.when(lost & (quality == "good"), "partial").otherwise(quality).alias("quality"))
