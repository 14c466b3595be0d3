"""CSV in a text as records and cells, as Column functions: quoted cells hold commas, line breaks and doubled quotes.

A quote opens a quoted cell at its start only; what follows the closing quote up to the comma is part of the cell; a
quote that is never closed takes the rest. A blank line is a record without cells. Loops in the patterns are possessive,
so a long cell needs no stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+|\z)'
_CELL = rf'(?:{_QUOTED}|[^,"\r\n][^,\r\n]*+|)'
_RECORD = rf"({_CELL}(?:,{_CELL})*+)(?:\r\n|\n|\r|\z)"
_IN_RECORD = rf",({_CELL})"


def _plain(cell: Column) -> Column:
    parts = r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"?+(.*+)\z'
    inner, rest = F.regexp_extract(cell, parts, 1), F.regexp_extract(cell, parts, 2)
    return F.when(cell.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)).otherwise(cell)


def cells(record: Column) -> Column:
    """The cells of one record; none of a blank one."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_IN_RECORD), F.lit(1))
    return F.when(record == "", F.array().cast("array<string>")).otherwise(F.transform(found, _plain))


def records(text: Column) -> Column:
    """The records of a text, each an array of cells."""
    found = F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))
    # the end of the text always matches once more
    return F.transform(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), cells)


def joined(text: Column) -> Column:
    """The records that are not blank as lines, cells joined by ` | `."""
    there = F.filter(records(text), lambda r: F.exists(r, lambda c: c.rlike(r"\S")))
    return F.array_join(F.transform(there, lambda r: F.array_join(r, " | ")), "\n")
