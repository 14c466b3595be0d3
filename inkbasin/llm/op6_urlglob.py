"""URL filter by a bit-parallel wildcard automaton.

All glob rules are packed into one Shift-And machine of several 64-bit words: bit i of a rule is set while its first
i symbols match the text read so far. Reading a byte shifts all rules at once, carrying between words, and masks them
with the byte's word; states before a `*` also keep themselves. A batch of URLs advances together, one column at a time.

A URL is made canonical first: host (after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased) and path
(from there up to `?`, `#` or the end); without `://`, or null, both are empty. The machine reads `.host`, a mark (byte
0xFF, which UTF-8 never uses) and the path, so that a rule `(org, /)` is the glob `*.org<mark>/*`.

Verdict: the longest fitting rule's (host and path together; between equals a block wins), else block if a glob of
`globs` matches `.host` + mark + path, else allow. Ties, repeated rows, empty and very long URLs and an empty table
need no special case; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbasin.llm.common import small_batches, table

MARK = 0xFF
#: Rules of the query: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Globs of hosts that are blocked where no rule fits; `|` stands between host and path.
GLOBS = ["*.spam-*|*", "*.casino*|*", "*|*/adclick/*", "*|*.exe"]


class GlobMachine:
    """Simulates all patterns (bytes, `*` any run, `?` any byte) over many texts at once."""

    def __init__(self, patterns: list[bytes]):
        parsed = []
        for p in patterns:
            symbols, loops = [], {0} if p[:1] == b"*" else set()
            for c in p:
                if c == 42:
                    loops.add(len(symbols))
                else:
                    symbols.append(c)
            parsed.append((symbols, loops))
        bits = sum(len(s) + 1 for s, _ in parsed)
        self.words = max(1, -(-bits // 64))
        step, loop, first = np.zeros((256, bits), bool), np.zeros(bits, bool), np.zeros(bits, bool)
        self.ends, at = [], 0
        for symbols, loops in parsed:
            first[at] = True
            for i, c in enumerate(symbols):
                step[slice(None) if c == 63 else c, at + i + 1] = True
            loop[[at + i for i in loops]] = True
            at += len(symbols) + 1
            self.ends.append(at - 1)
        self.step, self.loop, self.first = self._pack(step), self._pack(loop[None])[0], self._pack(first[None])[0]

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        whole = np.zeros((len(bits), self.words * 64), np.uint8)
        whole[:, : bits.shape[1]] = bits
        return np.packbits(whole, axis=1, bitorder="little").view("<u8")

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Whether each text matches each pattern, as a whole."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))  # those still being read stay in front
        out = np.zeros((len(texts), len(self.ends)), bool)
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        state = np.tile(self.first, (len(texts), 1))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(order) else lengths
        joined = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        live = len(order)
        for column in range(int(lengths[0]) if live else 0):
            while lengths[live - 1] <= column:
                live -= 1
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.step[joined[starts[:live] + column]] | now & self.loop
        for k, end in enumerate(self.ends):
            out[order, k] = state[:, end >> 6] >> np.uint64(end & 63) & np.uint64(1) != 0
        return out


def canonical():
    """(host, path) Columns of a url Column's text."""

    def parts(url):
        rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
        rest = F.coalesce(rest, F.lit(""))
        host = F.regexp_extract(rest, r"^[^/?#]*", 0)
        path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
        return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path

    return parts(F.col("url"))


def _judge(rules: list[tuple[str, str, str]], globs: list[str]):
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1:]))
    mark = bytes([MARK])
    escape = lambda x: x.encode()
    patterns = [b"*." + escape(h) + mark + escape(p) + b"*" for _, h, p in ranked] + [g.encode().replace(b"|", mark) for g in globs]
    names = [h + p for _, h, p in ranked]

    @F.arrow_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        machine = GlobMachine(patterns)
        for host, path in batches:
            hits = machine.match([b"." + h.encode() + mark + p.encode() for h, p in zip(host.to_pylist(), path.to_pylist())])
            fits, spam = hits[:, : len(ranked)], hits[:, len(ranked) :].any(axis=1)
            first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1) if len(ranked) else np.full(len(hits), -1)
            rule = [names[i] if i >= 0 else None for i in first]
            verdict = [ranked[i][0] if i >= 0 else "block" if s else "allow" for i, s in zip(first, spam)]
            yield pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["rule", "verdict"])

    return judge.asNondeterministic()  # so that it is planned once


def judge_urls(pages: DataFrame, rules=None, globs=None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url)."""
    small_batches(pages.sparkSession)
    host, path = canonical()
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    judge = _judge(RULES if rules is None else rules, GLOBS if globs is None else globs)
    return split.select("page_id", "host", "path", judge("host", "path").alias("found")).select("page_id", "host", "path", "found.rule", "found.verdict")


def op6_url_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
ORACLE_SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
hosts AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS raw FROM rest),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
ruled AS (SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _BY_LENGTH)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for v, h, p in _BY_LENGTH)}
    WHEN '.' || host LIKE '%.spam-%' OR '.' || host LIKE '%.casino%' OR path LIKE '%/adclick/%' OR path LIKE '%.exe' THEN 'block' ELSE 'allow' END AS verdict FROM parts)
SELECT page_id, host, path, rule, verdict FROM ruled
"""
