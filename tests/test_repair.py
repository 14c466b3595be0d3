"""Broken JSON and CSV: expected values written by hand, and Python's csv as the measure."""

import csv
import io
import json
import random

from pyspark.sql import functions as F

from inkbasin.functions import csvtext
from inkbasin.functions import jsonrepair as J

BROKEN = [
    ('{"title": "He said "hi" to me", "n": 1}', {"title": 'He said "hi" to me', "n": 1}),
    ("{'title': 'a', 'list': [1, 2,], 'b': None}", {"title": "a", "list": [1, 2], "b": None}),
    ("{'a': 'don\\'t \"do\"', b: 'x'}", {"a": 'don\'t "do"', "b": "x"}),
    ('{title: "x", tags: [a, b c], ok: True}', {"title": "x", "tags": ["a", "b", "c"], "ok": True}),
    ('{"title": "cut off here and', {"title": "cut off here and"}),
    ('{"a": {"b": [1, 2, {"c": "d"', {"a": {"b": [1, 2, {"c": "d"}]}}),
    ('{"a": [1, 2', {"a": [1, 2]}),
    ('{"a": "x", "b":', {"a": "x", "b": None}),
    ('{"a": 1 "b": 2}', {"a": 1, "b": 2}),
    ('{"a": "line\nbreak\ttab", "b": [1 2 3]}', {"a": "line\nbreak\ttab", "b": [1, 2, 3]}),
    ('Sure! {"a": , "b":, "c": 1,,} hope {that} helps', {"a": None, "b": None, "c": 1}),
    ('{"a": "x\\', {"a": "x"}),
    ('{"a": "say \\"yes\\" and "no", then go", "b": ["p "q" r", "s"]}', {"a": 'say "yes" and "no", then go', "b": ['p "q" r', "s"]}),
    ('{"a": 01, "b": 1.5, "c": -2, "d": "\\d \\u00e9 \\\\"', {"a": "01", "b": 1.5, "c": -2, "d": "d é \\"}),
    ("```json\n{'a': [{'b': 1}, {'b': 2}]\n```", {"a": [{"b": 1}, {"b": 2}]}),
    ('{"a": "' + "long \\n text " * 30_000, {"a": ("long \n text " * 30_000)[:-1]}),
    ('{"a": ' + "[" * 40 + "1", {"a": json.loads("[" * 40 + "1" + "]" * 40)}),
    ("no json", None), ("{", None), ("{}", {}), ("", None), (None, None), ("{:}", None),
]


def test_mended_json(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BROKEN)], "i int, t string")
    got = {r.i: r.v for r in rows.select("i", F.to_json(J.parsed(F.col("t"))).alias("v")).collect()}
    for i, (text, value) in enumerate(BROKEN):
        assert (None if got[i] is None else json.loads(got[i])) == value, text[:80] if text else text


def test_whole_json_stays(spark):
    """What Python parses comes out the same, whatever its texts hold."""
    rng = random.Random(3)
    piece = lambda: "".join(rng.choice(['"', "'", ",", ":", "}", "]", "{", "\\", "\n", "a", " ", "é", "1"]) for _ in range(12))
    values = [{piece(): piece(), "k": [piece(), {"x": piece()}, 1, None, True]} for _ in range(200)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string")
    got = {r.i: json.loads(r.v) for r in rows.select("i", F.to_json(J.parsed(F.col("t"))).alias("v")).collect()}
    assert got == dict(enumerate(values))


CSV = ["", "a", "a,b\n", 'x,"y, z"\n"multi\nline","say ""hi"""\n\n,,\n"",b\r\nlast', '"open, never\nclosed', 'a"b,"c"d"e,f\n', "\n\n", '"",""', ",", "a,b\r\rc", '5" pipe,3\n']


def test_csv_records(spark):
    rng = random.Random(5)
    texts = CSV + ["".join(rng.choice(['"', ",", "\n", "\r\n", "a", " b", '""']) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", csvtext.records(F.col("t")).alias("r"), csvtext.joined(F.col("t")).alias("j")).collect()
    for r in rows:
        expected = list(csv.reader(io.StringIO(texts[r.i], newline="")))
        assert r.r == expected, repr(texts[r.i])
        assert r.j == "\n".join(" | ".join(x) for x in expected if any(c.strip() for c in x))


def test_csv_long_cell(spark):
    text = '"' + "x,\n" * 200_000 + '",b\n' + ",".join(["c"] * 20_000) + "\n"
    got = spark.createDataFrame([(text,)], "t string").select(csvtext.records(F.col("t")).alias("r")).first().r
    assert got[0] == ["x,\n" * 200_000, "b"] and got[1] == ["c"] * 20_000 and len(got) == 2
