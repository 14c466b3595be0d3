"""All queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from inkbasin.plans import classify, evaluation, facts, files, lists, media, packages, records, replies, reports, sessions, surface

_MODULES = (files, classify, facts, lists, sessions, reports, media, records, packages, evaluation, replies, surface)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
