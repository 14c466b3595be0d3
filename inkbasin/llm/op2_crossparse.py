"""Language identification by cross-parsing entropy.

For every language a suffix automaton recognises the substrings of a sample of its labelled text. A text is parsed
greedily against each automaton: every phrase is the longest match with the sample, and a symbol that the sample
doesn't have is a phrase of its own. The language that needs the fewest phrases per symbol wins.

The samples are bounded: `sample_bytes` symbols a language, so what is sent to the executors is at most languages x
sample_bytes. They are stretches of sample_bytes / sample_rows symbols at hash-chosen places of the whole texts: one
of each drawn text, more where a language has few texts, and all of a language that has no more than sample_bytes. A
text and a stretch count once, and more is drawn until a sample is full or the language is used up. Predictions read
whole texts. Automata become dense tables, and a
batch of texts walks them in parallel, in stretches of STRETCH symbols (a phrase ends where a stretch ends).

Symbols are the bytes of the lower-cased text, with everything that is ASCII and not a letter as one space. A null
text, or one without any letter, gets `und` with score 0; so do all texts when no labelled row can be learned from.
Ties go to the language with more labelled rows, then to the smaller code. Repeated rows and null ids don't matter;
an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbasin.llm.common import free_names, give_back, id_text, small_batches, table

STRETCH = 256
_PAD, _SPACE, _BREAK, _FIRST = 0, 1, 2, 3  # symbol classes; a break stands between sampled rows and matches nothing
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_built: dict = {}


def symbols(text: str) -> bytes:
    """Lower case, every run of ASCII other than letters as one space."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_FOLD), np.uint8)
    if not len(raw):
        return b""
    keep = raw != 32
    keep[1:] |= raw[:-1] != 32
    return raw[keep].tobytes()


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that has a path from state 0 for exactly the substrings of text."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = step[at][symbol]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = copy
                while at >= 0 and step[at].get(symbol) == to:
                    step[at][symbol] = copy
                    at = link[at]
        last = new
    return step


def _tables(samples: list[tuple[str, list[bytes]]]):
    """The classes of bytes, and for each language a table: (next row's start << 2 | phrases that end) by state and class."""
    key = hash(tuple((k, *v) for k, v in samples))
    if key not in _built:
        known = sorted({b for _, rows in samples for r in rows for b in r} - {32})
        classes = np.full(256, _FIRST + len(known), np.int32)  # the last class: bytes of no sample
        classes[known] = np.arange(len(known)) + _FIRST
        classes[32] = _SPACE
        width = len(known) + _FIRST + 1
        tables = []
        for _, rows in samples:
            text = [c for r in rows for c in [*classes[np.frombuffer(r, np.uint8)].tolist(), _BREAK]]
            step = suffix_automaton(text)
            start = np.zeros(width, np.int64)
            ends = np.full(width, 2, np.int64)
            for c, to in step[0].items():
                start[c], ends[c] = to * width, 1
            # a symbol that doesn't go on ends the phrase and opens one; a symbol that the sample lacks ends another
            dense = np.tile((start << 2 | ends).astype(np.int32), (len(step), 1))
            dense[0] = start << 2 | (ends - 1)
            for s, moves in enumerate(step):
                for c, to in moves.items():
                    dense[s, c] = to * width << 2
            dense[:, [_PAD, _BREAK]] = 1
            dense[0, [_PAD, _BREAK]] = 0
            tables.append(dense.ravel())
        _built.clear()
        _built[key] = classes, tables
    return _built[key]


def phrases(texts: list[bytes], samples: list[tuple[str, list[bytes]]]) -> np.ndarray:
    """Phrases by text and language."""
    classes, tables = _tables(samples)
    lengths = np.array([len(t) for t in texts], np.int64)
    rows = -(-lengths // STRETCH)
    owner = np.repeat(np.arange(len(texts)), rows)
    joined = np.frombuffer(b"".join(t.ljust(int(n) * STRETCH, b"\0") for t, n in zip(texts, rows)), np.uint8)
    padded = classes[joined]
    padded[joined == 0] = _PAD
    lanes = np.ascontiguousarray(padded.reshape(-1, STRETCH).T)
    out = np.zeros((len(texts), len(tables)), np.int64)
    for k, dense in enumerate(tables):
        state, count = np.zeros(lanes.shape[1], np.int32), np.zeros(lanes.shape[1], np.int32)
        for column in lanes:
            got = dense[state + column]
            count += got & 3
            state = got >> 2
        count += state > 0
        out[:, k] = np.bincount(owner, weights=count, minlength=len(texts))
    return out


def _predict(samples: list[tuple[str, list[bytes]]]):
    @F.arrow_udf("lang string, score double, rate double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            yield from predicted(batches)
        finally:  # a reused worker holds no automata
            _built.clear()
            give_back()

    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lang: list = []
            score: list = []
            rate: list = []
            texts = batch.to_pylist()
            a = 0
            while a < len(texts):  # some MB at once
                b, size = a, 0
                while b < len(texts) and (b == a or size < 2 << 20):
                    size += len(texts[b] or "")
                    b += 1
                part = [symbols(t) if t and _LETTER.search(t) else b"" for t in texts[a:b]]
                counts = phrases(part, samples) if samples else np.zeros((b - a, 0), np.int64)
                for t, c in zip(part, counts):
                    if not t or not samples:
                        lang.append("und"), score.append(0.0), rate.append(None)
                        continue
                    best = int(c.argmin())
                    rest = np.delete(c, best).min() if len(c) > 1 else len(t)
                    lang.append(samples[best][0]), rate.append(c[best] / len(t))
                    score.append(max(0.0, 1 - c[best] / rest) if rest else 0.0)
                a = b
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], ["lang", "score", "rate"])

    return predict.asNondeterministic()  # so that it is planned once


def _stretches(each: int):
    @F.arrow_udf("array<binary>")
    def stretches(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, caps, seeds in batches:
            out = []
            for text, cap, seed in zip(texts.to_pylist(), caps.to_pylist(), seeds.to_pylist()):
                s = symbols(text)
                if not cap or len(s) <= each:  # no cap: the whole text
                    out.append([s] if s else [])
                    continue
                n = -(-len(s) // each)
                places = np.random.default_rng(seed & (1 << 63) - 1).choice(n, min(n, -(-cap // each)), replace=False)
                starts = [min(int(i) * each, len(s) - each) for i in places]
                out.append([s[x : x + each] for x in starts])
            yield pa.array(out, pa.list_(pa.binary()))

    return stretches.asNondeterministic()  # so that it is planned once


def _draw(sizes: list[tuple[int, int, int]], each: int, want: int, sample_bytes: int) -> tuple[float, int, bool]:
    """The rate of texts and the symbols of each (0: whole) that give about `want`, and whether that is all there is.

    sizes: (texts, symbols, symbols of the longest) by class of length.
    """
    total, longest = sum(x[1] for x in sizes), max(x[2] for x in sizes)
    if total <= sample_bytes:
        return 1.0, 0, True
    held = lambda cap: sum(min(symbols_, n * cap) for n, symbols_, _ in sizes)
    if held(each) >= want:
        return want / held(each), each, False
    cap = each
    while cap < longest and held(cap) < want:
        cap *= 2
    return 1.0, cap, cap >= longest


def samples_of(docs: DataFrame, learn, sample_rows: int, sample_bytes: int) -> list[tuple[str, list[bytes]]]:
    """Per language, most rows first: stretches of its distinct texts, sample_bytes symbols or all there are."""
    each = max(1, sample_bytes // sample_rows)
    # texts are told apart by their symbols, so that neither copies nor other digits in a form fill a sample
    folded = F.regexp_replace(F.lower("text"), r"[\x00-\x60\x7b-\x7f]+", " ")
    labelled = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", folded.alias("folded"))
    hashed = labelled.select("lang", "text", F.xxhash64("folded").alias("hash"), F.octet_length("folded").alias("size"))
    texts = hashed.groupBy("lang", "hash").agg(F.max("size").alias("size"), F.count("*").alias("rows"))
    classes = texts.groupBy("lang", F.floor(F.log2("size")).alias("class")).agg(F.count("*"), F.sum("size"), F.max("size"), F.sum("rows"))
    sizes: dict[str, list[tuple[int, int, int]]] = {}
    rows: dict[str, int] = {}
    for lang, _, n, total, longest, copies in classes.collect():
        sizes.setdefault(lang, []).append((n, total, longest))
        rows[lang] = rows.get(lang, 0) + copies
    out: dict[str, list[bytes]] = {}
    want, open_ = sample_bytes * 3 // 2, sorted(rows)  # more than needed, as stretches repeat
    while open_:
        plan = {lang: _draw(sizes[lang], each, want, sample_bytes) for lang in open_}
        rate, cap = (F.create_map(*(F.lit(x) for lang in open_ for x in (lang, plan[lang][i])))[F.col("lang")] for i in (0, 1))
        drawn = hashed.filter(F.col("lang").isin(open_) & (F.pmod("hash", F.lit(1 << 30)) < rate * (1 << 30)))
        parts = drawn.select("lang", "hash", F.posexplode(_stretches(each)("text", cap, "hash")).alias("turn", "part"))
        got = parts.groupBy("lang", "part").agg(F.min("turn").alias("turn"), F.min("hash").alias("hash")).collect()
        found: dict[str, list[bytes]] = {}
        for r in sorted(got, key=lambda r: (r.lang, r.turn, r.hash, bytes(r.part))):  # each text once before one twice
            found.setdefault(r.lang, []).append(bytes(r.part))
        left = []
        for lang in open_:
            kept, total = [], 0
            for p in found.get(lang, []):
                kept.append(p[: sample_bytes - total])
                total += len(kept[-1])
            out[lang] = [p for p in kept if p]
            if total < sample_bytes and not plan[lang][2]:
                left.append(lang)
        open_, want = left, want * 4
    return [(lang, out[lang]) for lang in sorted(rows, key=lambda x: (-rows[x], x)) if out[lang]]


def identify(docs: DataFrame, learn=None, sample_rows: int = 200, sample_bytes: int = 20_000):
    """A Column function text -> struct(lang, score, rate), learned from the rows of docs (text, lang) where learn holds.

    rate: phrases per symbol of the winning language, null for `und`.
    """
    learn = F.lit(True) if learn is None else learn
    small_batches(docs.sparkSession)
    return _predict(samples_of(docs, learn, sample_rows, sample_bytes))


def held_out():
    return F.crc32(id_text()) % 4 == 2


def keep_language(spark: SparkSession, docs: DataFrame, most_rate: float = 0.67) -> DataFrame:
    """The rows of docs whose text is in one of its languages; a null lang is filled in.

    Rejected: `und`, and texts with phrases shorter than 1.5 symbols on average, which are in no learned script.
    """
    (found,) = free_names(docs.columns, "_found")
    kept = docs.select("*", identify(docs)("text").alias(found)).filter((F.col(f"{found}.lang") != "und") & (F.col(f"{found}.rate") <= most_rate))
    return kept.select(*(F.coalesce("lang", F.col(f"{found}.lang")).alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def op2_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out().alias("held_out"), identify(docs, ~held_out())("text").alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")
