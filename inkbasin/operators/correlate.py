"""Related files: groups by stem, deck and recording pairs, confirmation, session merge."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from inkbasin import layouts, rules
from inkbasin.functions import overlays
from inkbasin.functions.arrays import dedupe, jaccard
from inkbasin.functions.template import compiled
from inkbasin.functions.text import extension, file_name, normalize_stem, pair_hash, session_id, stem_prefix, title_case, words
from inkbasin.operators.facts import deduplicated


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings; names repeat, so each pair is computed once a batch."""
    seen: dict = {}
    return pd.Series([seen[p] if p in seen else seen.setdefault(p, SequenceMatcher(None, p[0], p[1]).ratio()) for p in zip(a, b)], dtype="float64")


def primary_order(type_: Column) -> Column:
    out = F.lit(len(rules.PRIMARY_ORDER))
    for i, t in reversed(list(enumerate(rules.PRIMARY_ORDER))):
        out = F.when(type_ == t, i).otherwise(out)
    return out


def file_groups(files: DataFrame) -> DataFrame:
    """files (path, name, type) as prefix, primary path, related paths; a group is one topic's files in a folder."""
    first = F.struct(primary_order(F.col("type")).alias("o"), "path")
    grouped = files.groupBy(stem_prefix(F.col("name")).alias("prefix")).agg(F.array_sort(F.collect_list(first)).alias("all"))
    paths = F.transform("all", lambda x: x["path"])
    return grouped.select("prefix", F.get(paths, F.lit(0)).alias("primary"), F.array_sort(F.slice(paths, 2, F.greatest(F.size("all") - 1, F.lit(0)))).alias("related"))


def correlated(files: DataFrame, few: int = 3) -> DataFrame:
    """files (input, path, name, type; title where one was extracted): group, role (primary or related) and place of each.

    An input of `few` files at most is one group, named by its primary file's title, or name, in title case. Else files
    go by the prefix of their names, and a group has its primary file's title, its prefix or its name. The primary file
    is the first by type, then by path. One row a file, so a group may be of any size.
    """
    named = files if "title" in files.columns else files.withColumn("title", F.lit(None).cast("string"))
    sizes = files.groupBy("input").agg(F.count("*").alias("_files"))
    rows = named.join(sizes, "input").withColumn("_few", F.col("_files") <= few).withColumn("_prefix", F.when(F.col("_few"), "").otherwise(stem_prefix(F.col("name"))))
    order = Window.partitionBy("input", "_prefix").orderBy(primary_order(F.col("type")), "path")
    title, name = (F.first(F.nullif(c, F.lit(""))).over(order) for c in (F.col("title"), F.col("name")))
    group = F.when(F.col("_few"), title_case(F.coalesce(title, name))).otherwise(F.coalesce(title, F.nullif("_prefix", F.lit("")), name))
    placed = rows.withColumns({"group": group, "place": F.row_number().over(order)})
    return placed.withColumn("role", F.when(F.col("place") == 1, "primary").otherwise("related")).drop("_files", "_few", "_prefix")


def session_candidates(files: DataFrame, least: float = 0.6) -> DataFrame:
    """files (folder, path): pairs of a deck and a recording in one folder with similar names: folder, deck, video, similarity."""
    ext = extension(F.col("path"))
    named = files.select("folder", "path", normalize_stem(F.col("path")).alias("stem"), ext.alias("ext"))
    decks = named.filter("ext = '.pptx'").select("folder", F.col("path").alias("deck"), F.col("stem").alias("a"))
    videos = named.filter(F.col("ext").isin(rules.SESSION_VIDEO)).select("folder", F.col("path").alias("video"), F.col("stem").alias("b"))
    pairs = decks.join(videos, "folder").withColumn("similarity", similarity("a", "b"))
    return pairs.filter(F.col("similarity") >= least).select("folder", "deck", "video", "similarity")


def _assign(rows: pd.DataFrame) -> pd.DataFrame:
    taken: set = set()
    keep = []
    for r in rows.sort_values(["similarity", "deck", "video"], ascending=[False, True, True], kind="stable").itertuples():
        keep.append(r.deck not in taken and r.video not in taken)
        if keep[-1]:
            taken |= {r.deck, r.video}
    return rows.sort_values(["similarity", "deck", "video"], ascending=[False, True, True], kind="stable")[keep]


def assigned(candidates: DataFrame) -> DataFrame:
    """Best pairs first, each file once. A folder is matched as a whole; only its candidate pairs are held."""
    out = candidates.groupBy("folder").applyInPandas(_assign, candidates.select("folder", "deck", "video", "similarity").schema)
    return out.withColumn("stage1", F.least(F.lit(100), (F.col("similarity") * 100).cast("int")))  # truncated


def standalone(files: DataFrame, pairs: DataFrame) -> DataFrame:
    used = pairs.select(F.explode(F.array("deck", "video")).alias("path"))
    return files.join(used, "path", "left_anti")


def confirmed(pairs: DataFrame) -> DataFrame:
    """pairs (similarity, stage1, deck_title, video_title, deck_slides, video_slides, deck_topics, video_topics) with the verdict.

    merge with two signals or more of: similarity over 0.65, title words over 0.5, slide counts within 3 or a quarter,
    topics over 0.6.
    """
    c = F.col
    low = lambda x: F.transform(F.coalesce(x, F.array().cast("array<string>")), F.lower)
    titles = jaccard(words(F.lower("deck_title")), words(F.lower("video_title")))
    gap, most = F.abs(c("deck_slides") - c("video_slides")), F.greatest("deck_slides", "video_slides")
    slides = (c("deck_slides") > 0) & (c("video_slides") > 0) & ((gap <= 3) | (gap / F.greatest(most, F.lit(1)) <= 0.25))
    topics = (F.size(low(c("deck_topics"))) > 0) & (F.size(low(c("video_topics"))) > 0) & (jaccard(low(c("deck_topics")), low(c("video_topics"))) > 0.6)
    signal = lambda x: F.when(F.coalesce(x, F.lit(False)), 1).otherwise(0)
    out = pairs.withColumn("signals", signal(c("similarity") > 0.65) + signal(titles > 0.5) + signal(slides) + signal(topics))
    merge = c("signals") >= 2
    confidence = F.when(merge, F.least(F.lit(100), ((c("stage1") + c("signals") * 25) / 2).cast("int")).cast("double")).otherwise(c("stage1") * 0.5)
    return out.withColumns({"confidence": confidence, "decision": F.when(merge, "merge").otherwise("crosslink")})


def merged_sessions(pairs: DataFrame, *keep: str) -> DataFrame:
    """Confirmed pairs (deck, video, hashes, titles; lists, overlays as VARIANT and their types where there are any) as one record each; deck values come first."""
    c = F.col
    for name in (f"{n}_{k}" for n in ("deck", "video") for k in ("topics", "people", "products", "entities", "domains", "overlay", "overlay_type")):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, F.lit(None).cast(_SIDE[name.partition("_")[2]]))
    union = {n: dedupe(F.concat(F.coalesce(f"deck_{n}", F.array().cast("array<string>")), F.coalesce(f"video_{n}", F.array().cast("array<string>")))) for n in ("topics", "people", "products", "entities", "domains")}
    return pairs.select(
        *keep, session_id(c("deck")).alias("session_id"), "deck", "video", pair_hash(c("deck_hash"), c("video_hash")).alias("session_hash"),
        F.coalesce(F.nullif(c("deck_title"), F.lit("")), c("video_title")).alias("title"), *(v.alias(k) for k, v in union.items()),
        overlays.merged(c("deck_overlay"), c("video_overlay")).alias("overlay"), F.coalesce("deck_overlay_type", "video_overlay_type").alias("overlay_type"),
    )


#: What sessions need of the extraction of a file. facts: texts, or (fact, slide_ref); walk: the slides with what was said.
_SIDE = {
    "hash": "string", "title": "string", "summary": "string", "slides": "int", "topics": "array<string>", "people": "array<string>", "products": "array<string>", "entities": "array<string>", "domains": "array<string>", "overlay": "variant", "overlay_type": "string",
    "facts": "array<struct<fact:string,slide_ref:string>>", "extracted_at": "string", "quotes": "string", "walk": "array<struct<slide_number:string,title:string,frame_path:string,speaker_explanation:string,so_what:string,warning:string>>",
}
#: What either source gives to a session, and how the two were found to belong together.
CONTRIBUTIONS = {"mp4": ["slide_frames", "speaker_commentary", "visual_context"], "pptx": ["key_facts", "overlay", "entities", "topics", "products"]}
METHOD = "filename_similarity + title_match"


def confirmed_pairs(files: DataFrame, extractions: DataFrame) -> DataFrame:
    """Decks and recordings of one folder that belong together by name, with what was extracted from both and the verdict.

    files (folder, path), extractions (path and the columns of _SIDE). A pair of which one extraction is missing is left out.
    """
    there = dict(extractions.dtypes)

    def of(name: str):
        if name not in there:
            return F.lit(None).cast(_SIDE[name])
        if name == "facts" and there[name] == "array<string>":
            return F.transform(name, lambda x: F.struct(x.alias("fact"), F.lit(None).cast("string").alias("slide_ref")))
        return F.col(name).cast(_SIDE[name]) if name in ("facts", "walk") else F.col(name)

    side = lambda n: extractions.select(F.col("path").alias(n), *(of(c).alias(f"{n}_{c}") for c in _SIDE))
    return confirmed(assigned(session_candidates(files)).join(side("deck"), "deck").join(side("video"), "video"))


def sessions(pairs: DataFrame) -> DataFrame:
    """confirmed_pairs as session records: merged lists, overlays and facts, both sources, confidence of the correlation.

    Facts (array of texts on either side) are merged as in facts.deduplicated, in its order; a session is one deck and
    one recording, so its facts are held together. Pairs that are only cross-linked are left out.
    """
    merge = pairs.filter("decision = 'merge'")
    c = F.col
    source = lambda n, modality: F.struct(F.lit(modality).alias("modality"), F.replace(c(n), F.lit("\\"), F.lit("/")).alias("path"), c(f"{n}_hash").alias("hash"), F.coalesce(f"{n}_extracted_at", F.lit("")).alias("extracted_at"), F.array(*map(F.lit, CONTRIBUTIONS[modality])).alias("contribution"))
    walk = F.coalesce("video_walk", F.array().cast(_SIDE["walk"]))
    refs = F.coalesce("deck_facts", F.array().cast(_SIDE["facts"]))
    about = merge.select("deck", F.array(source("video", "mp4"), source("deck", "pptx")).alias("sources"), c("confidence").cast("int").alias("confidence"), F.lit(METHOD).alias("method"), c("video_summary").alias("summary"), c("video_quotes").alias("quotes"), walk.alias("walk"), refs.alias("refs"))
    said = lambda n, modality: F.transform(F.filter(F.coalesce(f"{n}_facts", F.array().cast(_SIDE["facts"])), lambda x: x["fact"].isNotNull()), lambda x: F.struct(F.lit(modality).alias("modality"), x["fact"].alias("fact")))
    each = merge.select(c("deck").alias("session"), F.posexplode(F.concat(said("deck", "pptx"), said("video", "mp4"))).alias("pos", "f")).select("session", "pos", "f.*")
    facts = deduplicated(each).groupBy(c("session").alias("deck")).agg(F.array_sort(F.collect_list(F.struct("rank", "fact", "modality", "conflict"))).alias("key_facts"))
    none = F.array().cast(facts.schema["key_facts"].dataType)
    records = merged_sessions(merge).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled Session")))
    out = records.join(about, "deck").join(facts, "deck", "left").withColumn("key_facts", F.coalesce("key_facts", none))
    # the slide that a fact of the deck names
    ref = lambda f: F.get(F.transform(F.filter("refs", lambda r: (r["fact"] == f["fact"]) & (f["modality"] != "mp4")), lambda r: r["slide_ref"]), F.lit(0))
    return out.withColumn("key_facts", F.transform("key_facts", lambda f: F.struct(f["rank"].alias("rank"), f["fact"].alias("fact"), f["modality"].alias("modality"), f["conflict"].alias("conflict"), ref(f).alias("slide_ref")))).drop("refs")


def slide_facts(slides: DataFrame, facts: DataFrame) -> DataFrame:
    """slides (package, slide) with the facts (package, pos, fact, slide_ref) that name them, compared as texts, in order."""
    named = facts.filter("slide_ref IS NOT NULL").groupBy("package", F.col("slide_ref").cast("string").alias("_ref")).agg(F.array_sort(F.collect_list(F.struct("pos", "fact"))).alias("_facts"))
    joined = slides.withColumn("_ref", F.col("slide").cast("string")).join(named, ["package", "_ref"], "left")
    return joined.withColumn("slide_facts", F.coalesce(F.transform("_facts", lambda f: f["fact"]), F.array().cast("array<string>"))).drop("_ref", "_facts")


def session_files(records: DataFrame, date: Column | None = None, layout: str = layouts.SESSION) -> DataFrame:
    """The note of each of sessions() with a package: (path, value)."""
    c = F.col
    slide = lambda s: F.struct(s["slide_number"].alias("slide_number"), F.coalesce(s["title"], F.concat(F.lit("Slide "), s["slide_number"])).alias("title"), s["frame_path"].alias("frame_path"), s["speaker_explanation"].alias("speaker_explanation"), s["so_what"].alias("so_what"), s["warning"].alias("warning"), F.transform(F.filter("key_facts", lambda f: f["slide_ref"] == s["slide_number"]), lambda f: f["fact"]).alias("key_facts"))
    name = F.regexp_replace("overlay_type", "_overlay", "")
    rows = records.withColumns({
        "date": F.date_format(F.current_timestamp() if date is None else date, "yyyy-MM-dd"), "overlay_name": title_case(F.replace(name, F.lit("_"), F.lit(" "))), "details": F.when(overlays.populated(c("overlay")) > 0, overlays.rendered(c("overlay"))),
        "slides": F.transform("walk", slide), "correlation": F.struct("confidence", "method"), "video_name": file_name(c("video")), "deck_name": file_name(c("deck")),
    })
    return rows.select(F.concat("package", F.lit("/extract/session_"), "session_id", F.lit(".md")).alias("path"), compiled(layout, rows).alias("value"))


def session_ids(notes: DataFrame, sessions: DataFrame) -> DataFrame:
    """notes (path, session_id) with the session of their file, where they have none yet."""
    members = sessions.select("session_id", F.explode(F.array("deck", "video")).alias("path")).withColumnRenamed("session_id", "_s")
    return notes.join(members, "path", "left").withColumn("session_id", F.coalesce("session_id", "_s")).drop("_s")


def renumbered(rows: DataFrame, by: str, order: str, start: int = 1) -> DataFrame:
    """Consecutive numbers of the kept rows of each group."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy(order)) + (start - 1))


def slide_frames(slides: DataFrame, frames: DataFrame) -> DataFrame:
    """slides (package, slide, frame_index) with the path of their frame; those without one are reported, not lost."""
    return slides.join(frames.select("package", "frame_index", F.col("path").alias("frame")), ["package", "frame_index"], "left").withColumn("missing", F.col("frame").isNull())
