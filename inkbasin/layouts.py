"""Layouts of notes, indexes, meta files and sidecars, as templates (functions/template.py) that callers may replace.

Fixed values: names and order of the fields that readers of packages expect, and headings of sections.
"""

from __future__ import annotations

#: Forms of a field of the block at the top: text in quotes, as it is, a list or object as JSON.
TEXT, PLAIN, JSON = '"{{{{ {} | escaped }}}}"', "{{{{ {} }}}}", "{{{{ {} | tojson }}}}"


def front(*fields: tuple) -> str:
    """The block of fields at the top of a note: (key, form, value) or (key, form, value, condition for the line)."""
    lines = []
    for key, form, value, *condition in fields:
        line = f"{key}: {form.format(value)}\n"
        lines.append(f"{{% if {condition[0]} %}}{line}{{% endif %}}" if condition else line)
    return "---\n" + "".join(lines) + "---\n"


def given(key: str, form: str = TEXT) -> tuple:
    """A field that is left out where it has no value."""
    return key, form, key, key


def bullets(name: str, items: str, title: str) -> str:
    """A section with a list, left out where the list is empty."""
    return f"{{% if {items} %}}\n## {title}\n\n{{% for {name} in {items} %}}\n- {{{{ {name} }}}}\n{{% endfor %}}\n{{% endif %}}\n"


_WORD = "{% set word = 'Section' if source_file.endswith('.pdf') or source_file.endswith('.docx') else 'Slide' %}\n"

NOTE_FIELDS = [
    ("source", TEXT, "source_file"), ("type", TEXT, "content_type"), ("title", TEXT, "title"), ("date", PLAIN, "date"),
    ("source_type", TEXT, "source_type | default('documentation')"), ("layer", TEXT, "layer | default('learning')"),
    ("domains", JSON, "domains | default([])"), ("topics", JSON, "topics"), ("people", JSON, "people"), ("products", JSON, "products"),
    ("confidentiality", TEXT, "confidentiality | default('internal')"), ("authority", TEXT, "authority | default('tribal')"),
    given("client"), given("project"), given("valid_to", PLAIN), ("language", TEXT, "language"), ("quality", TEXT, "quality"), given("duration_min", PLAIN),
    ("model", TEXT, "model"), given("routing_reason"), given("prompt_version"), ("tokens_used", PLAIN, "tokens_used"),
    ("quality_score", PLAIN, "quality_score", "quality_score is defined"), ("tag_validation_warnings", PLAIN, "tag_validation_warnings", "tag_validation_warnings > 0"),
    ("extraction_cost_usd", PLAIN, "'%.4f' | format(extraction_cost_usd)", "extraction_cost_usd is defined"), ("source_tool", TEXT, "source_tool | default('knowledge-extractor')"),
    ("schema_version", PLAIN, "2"), ("extraction_version", PLAIN, "extraction_version | default(1)"), ("depth", TEXT, "depth | default('standard')"),
    given("doc_type"), given("key_facts", JSON), given("entities_mentioned", JSON),
    ("source_path", TEXT, "freshness.source_path", "freshness"), ("source_hash", TEXT, "freshness.source_hash", "freshness"), ("source_mtime", TEXT, "freshness.source_mtime", "freshness"), ("extracted_at", TEXT, "freshness.extracted_at", "freshness"),
    given("tags", JSON), ("{{ doc_type }}_overlay", JSON, "overlay", "overlay and doc_type"),
]

_SLIDE = (
    "## {{ word }} {{ slide.slide_number }}: {{ slide.slide_title }}\n*{{ slide.timestamp_approx }}*\n\n"
    "![{{ word }} {{ slide.slide_number }}](../source/{{ slides_subdir | default('frames') }}/slide_{{ '%03d' | format(slide.slide_number) }}.png)\n\n"
    "{{ slide.speaker_insight }}\n\n{% if slide.so_what %}\n**So what:** {{ slide.so_what }}\n{% endif %}\n\n"
    "{% if slide.critical_notes %}\n> WARNING: {{ slide.critical_notes }}\n{% endif %}\n\n"
    "{% if slide.key_facts %}\n**Key facts:**\n{% for fact in slide.key_facts %}\n- {{ fact }}\n{% endfor %}\n{% endif %}\n\n---\n"
)

#: The note of an extraction.
NOTE = (
    front(*NOTE_FIELDS)
    + "\n# {{ title }}\n\n{{ links_line }}\n\n> Source: [Open original](file:///{{ source_file | replace('\\\\', '/') }})\n\n{{ summary }}\n\n"
    + _WORD
    + "{% for slide in slides %}\n" + _SLIDE + "{% endfor %}\n\n"
    + "{% for slide in slide_summaries %}\n## {{ word }} {{ slide.slide_number }}: {{ slide.title }}\n\n{{ slide.content }}\n\n{% endfor %}\n\n"
    + bullets("point", "key_points", "Key Takeaways") + "\n"
    + "{% if transcript_excerpt %}\n## Notable Quotes\n\n{{ transcript_excerpt }}\n{% endif %}\n\n"
    + "{% if flagged_facts %}\n## Flagged Facts\n\n{% for f in flagged_facts %}\n> **{{ f.verification_status | upper }}:** {{ f.fact }}{% if f.anomalies %}\n> {{ f.anomalies | join('; ') }}{% endif %}\n\n{% endfor %}\n{% endif %}"
)

#: The index of a package.
INDEX = (
    front(("id", TEXT, "id"), ("title", TEXT, "title"), ("date", PLAIN, "date"), ("types", JSON, "types"), ("topics", JSON, "topics"), ("people", JSON, "people"), ("products", JSON, "products"), ("file_count", PLAIN, "file_count"), ("model", TEXT, "model"))
    + "\n# {{ title }}\n\n{{ executive_summary }}\n\n## Contents\n\n"
    + "{% for group in groups %}\n### {{ group.group_name }}\n\n- **Primary:** `{{ group.primary.name }}` ({{ group.primary.type }})\n"
    + "{% if group.related %}\n- **Related:**\n{% for r in group.related %}  - `{{ r.name }}` ({{ r.type }})\n{% endfor %}\n{% endif %}\n\n{% endfor %}\n\n"
    + "## Key Takeaways\n\n{% for point in key_takeaways %}- {{ point }}\n{% endfor %}\n\n"
    + "\n".join(bullets("item", name, title) for name, title in (("all_people", "People Mentioned"), ("all_products", "Products & Systems"), ("action_items", "Action Items"), ("open_questions", "Open Questions")))
)

#: The meta file of a package.
META = (
    "".join(f'{key}: "{{{{ {key} }}}}"\n' for key in ("extracted_at", "model", "pipeline_version", "prompt_hash"))
    + "".join(f'{{% if {key} %}}{key}: "{{{{ {key} }}}}"\n{{% endif %}}' for key in ("cover_slide", "cover_frame"))
    + 'source_files:\n{% for f in source_files %}\n  - path: "{{ f.path | escaped }}"\n    type: "{{ f.type }}"\n    size_bytes: {{ f.size_bytes }}\n{% endfor %}\n'
)

#: The note of a transcript that is complete.
TRANSCRIPT = front(("type", PLAIN, "'transcript'"), ("source", PLAIN, "source_path | replace('\\\\', '/')"), ("title", TEXT, "title + ' — Full Transcript'"), ("duration_min", PLAIN, "duration_min"), ("word_count", PLAIN, "word_count"), ("linked_extraction", PLAIN, "linked_extraction")) + "\n{{ text }}"

#: The synthesis of a package.
SYNTHESIS = (
    "# Synthesis\n\n{% if available %}\n## Executive Summary\n\n{{ executive_summary }}\n"
    + "{% if key_takeaways %}\n\n## Key Takeaways\n\n{% for x in key_takeaways %}\n- {{ x }}\n{% endfor %}\n{% endif %}\n"
    + "{% if relationships %}\n\n## Relationships\n\n{{ relationships }}\n{% endif %}\n"
    + "{% if action_items %}\n\n## Action Items\n\n{% for x in action_items %}\n- {{ x }}\n{% endfor %}\n{% endif %}\n"
    + "{% if open_questions %}\n\n## Open Questions\n\n- {{ open_questions | join('\\n- ') }}{% endif %}\n"
    + "{% else %}\n_Synthesis not available._\n{% endif %}\n"
)

#: The note of a session of a deck and a recording.
SESSION = (
    front(
        ("title", TEXT, "title"), ("type", PLAIN, "'training_session'"), ("source_type", PLAIN, "'correlated_session'"), ("session_id", TEXT, "session_id"), ("session_hash", TEXT, "session_hash"), ("date", PLAIN, "date"), ("sources", JSON, "sources"),
        ("correlation", JSON, "correlation"), ("topics", JSON, "topics"), ("products", JSON, "products"), ("entities_mentioned", JSON, "entities"), ("people", JSON, "people"), ("key_facts", JSON, "key_facts"), ("domains", JSON, "domains"),
        ("confidentiality", PLAIN, "'internal'"), ("authority", PLAIN, "'approved'"), ("language", PLAIN, "'en'"), ("extraction_version", PLAIN, "2"), ("depth", PLAIN, "'deep'"), ("schema_version", PLAIN, "2"), ("source_tool", PLAIN, "'knowledge-extractor'"),
        ("{{ overlay_type }}", JSON, "overlay", "details and overlay_type"),
    )
    + "\n# {{ title }}\n\n{% if summary %}\n## Executive Summary\n\n{{ summary }}\n\n{% endif %}\n"
    + "{% if key_facts %}\n## Key Facts\n\n{% for f in key_facts %}\n- {{ f.fact }}\n{% endfor %}\n\n{% endif %}\n"
    + "{% if details and overlay_type %}\n## {{ overlay_name }} Details\n\n{{ details }}\n\n{% endif %}\n"
    + "{% if slides %}\n## Slide-by-Slide Walkthrough\n\n{% for s in slides %}\n{% if index > 1 %}\n\n---\n{% endif %}\n### Slide {{ s.slide_number }}: {{ s.title }}\n"
    + "{% if s.frame_path %}\n\n![Slide {{ s.slide_number }}]({{ s.frame_path }})\n{% endif %}\n{% if s.speaker_explanation %}\n\n**Speaker Commentary:** {{ s.speaker_explanation }}\n{% endif %}\n"
    + "{% if s.so_what %}\n\n**So what:** {{ s.so_what }}\n{% endif %}\n{% if s.key_facts %}\n\n**Key Facts (from deck):**\n{% for f in s.key_facts %}\n- {{ f }}\n{% endfor %}\n{% endif %}\n"
    + "{% if s.warning %}\n\n> WARNING: {{ s.warning }}\n{% endif %}\n{% endfor %}\n\n\n{% endif %}\n"
    + "{% if quotes %}\n## Notable Quotes\n\n{{ quotes }}\n\n{% endif %}\n"
    + "## Source Provenance\n\n- **Video:** `{{ video_name }}`\n- **Deck:** `{{ deck_name }}`\n- **Merge method:** Correlated session (PPTX structured facts + MP4 visual/speaker context)"
)

#: Fields of a sidecar, in order: those of a standard extraction. With a prompt of the user's own the reply is written as it came.
SIDECAR = "schema_version id source_file title summary topics products people domains key_points content_type source_type layer confidentiality authority client project slides_count links_line validation_result valid_to source_date facts processed_at extraction_version depth doc_type key_facts entities_mentioned overlay freshness".split()
