"""Overlays as objects: merge, first-wins lists, counts, lines; session notes."""

import json

from pyspark.sql import functions as F

from inkbasin.functions import overlays as O
from inkbasin.operators import correlate

CASES = [
    (None, None, {}),
    ({}, {"theme": "", "x": 1}, {"theme": "", "x": 1}),
    ({"attendees": ["A"], "y": 0}, {}, {"attendees": ["A"], "y": 0}),
    ({"attendees": ["Ann", {"name": "Bo", "role": "r"}]}, {"attendees": [" ann", "bo", "Cy", None]}, {"attendees": ["Ann", {"name": "Bo", "role": "r"}, "Cy", None]}),
    ({"action_items": [{"action": "Call", "by": 1}, {"owner": "x"}, {"decision": "d"}]}, {"action_items": [{"action": "call "}, {"owner": "x"}, {"question": "D"}, {"action": "", "concern": "Call"}]}, {"action_items": [{"action": "Call", "by": 1}, {"owner": "x"}, {"decision": "d"}]}),
    ({"theme": "", "level": 2, "list": []}, {"theme": "t", "level": 3, "list": [1], "none": None}, {"theme": "t", "level": 2, "list": [1]}),
    ({"next_steps": []}, {"next_steps": None, "theme": "a"}, {"theme": "a"}),
    ([1], {"next_steps": ["go", "Go"]}, {"next_steps": ["go", "Go"]}),
    ({"concerns_expressed": "alone"}, {"concerns_expressed": ["Alone", "two"]}, {"concerns_expressed": ["alone", "two"]}),
]


def test_merged(spark):
    rows = spark.createDataFrame([(i, None if a is None else json.dumps(a), None if b is None else json.dumps(b)) for i, (a, b, _) in enumerate(CASES)], "i int, a string, b string")
    got = rows.select("i", F.to_json(O.merged(F.parse_json("a"), F.parse_json("b"))).alias("m"), O.populated(F.parse_json("b")).alias("n")).orderBy("i").collect()
    for r, (_, b, expected) in zip(got, CASES):
        assert json.loads(r.m) == expected
        assert r.n == (sum(v not in (None, "", []) for v in b.values()) if isinstance(b, dict) else 0)


def test_names_and_lines(spark):
    one = spark.sql("""SELECT '{"a": 1, "z_overlay": {}, "b_overlay": {}}' AS j, parse_json('{"zeta_note": "n", "attendees": ["A", {"x": 1}], "action_items": [{"action": "go", "owner": "", "when": 3}, "plain"], "empty": [], "flag": true, "gone": ""}') AS v""")
    r = one.select(O.first_name(F.col("j")).alias("n"), O.rendered(F.col("v")).alias("l"), O.rendered(F.parse_json(F.lit("{}"))).alias("e"), O.first_name(F.lit("{}")).alias("none")).first()
    assert (r.n, r.none, r.e) == ("z_overlay", None, "No details available.")
    assert r.l == '- **Attendees:** A, {"x":1}\n- **Action Items:** action: go, when: 3\n- **Action Items:** plain\n- **Zeta Note:** n'


def test_session_note(spark):
    schema = "path string, hash string, title string, summary string, slides int, topics array<string>, people array<string>, products array<string>, entities array<string>, domains array<string>, overlay string, overlay_type string, facts array<struct<fact:string,slide_ref:string>>, extracted_at string, quotes string, walk array<struct<slide_number:string,title:string,frame_path:string,speaker_explanation:string,so_what:string,warning:string>>"
    deck = ("f/Talk one_slides.pptx", "h1", "Talk", None, 3, ["T"], [], [], ["E"], ["d"], '{"attendees": ["A"]}', "training_overlay", [("Uptime of 99 percent", "1"), ("Other thing of 7 units", None)], "then", None, None)
    film = ("f/Talk one_video.mp4", "h2", "Talk", "Short.", 3, ["t", "U"], [], [], ["e", "F"], [], '{"attendees": ["a", "B"]}', None, [("A third of 55 items", None)], None, "So it goes.", [("1", "One", "x.png", "said", "why", None), ("2", None, None, None, None, "careful")])
    side = spark.createDataFrame([deck, film], schema).withColumn("overlay", F.parse_json("overlay"))
    files = spark.createDataFrame([("f", deck[0]), ("f", film[0])], "folder string, path string")
    records = correlate.sessions(correlate.confirmed_pairs(files, side))
    r = records.first()
    assert (r.entities, r.domains, r.overlay_type, r.title) == (["E", "F"], ["d"], "training_overlay", "Talk")
    assert [(f.fact, f.modality, f.slide_ref) for f in r.key_facts] == [("Uptime of 99 percent", "pptx", "1"), ("Other thing of 7 units", "pptx", None), ("A third of 55 items", "mp4", None)]
    (path, text), = ((x.path, x.value) for x in correlate.session_files(records.withColumn("package", F.lit("p")), F.lit("2024-05-06").cast("date")).collect())
    assert path == "p/extract/session_talk-one-slides.md"
    front, body = text.split("---\n", 2)[1:]
    assert "\ntraining_overlay: " in front and 'confidence' in front and front.startswith('title: "Talk"\ntype: training_session\n')
    assert body == (
        "\n# Talk\n\n## Executive Summary\n\nShort.\n\n## Key Facts\n\n- Uptime of 99 percent\n- Other thing of 7 units\n- A third of 55 items\n\n## Training Details\n\n- **Attendees:** A, B\n\n"
        "## Slide-by-Slide Walkthrough\n\n### Slide 1: One\n\n![Slide 1](x.png)\n\n**Speaker Commentary:** said\n\n**So what:** why\n\n**Key Facts (from deck):**\n- Uptime of 99 percent\n\n---\n### Slide 2: Slide 2\n\n> WARNING: careful\n\n\n"
        "## Notable Quotes\n\nSo it goes.\n\n## Source Provenance\n\n- **Video:** `Talk one_video.mp4`\n- **Deck:** `Talk one_slides.pptx`\n- **Merge method:** Correlated session (PPTX structured facts + MP4 visual/speaker context)"
    )
