"""The named queries over the document-layout operators, with their SQL."""

from __future__ import annotations

from leafmill.plans import events, filtering, layout, markup, privacy, segments

QUERIES = {**layout.QUERIES, **filtering.QUERIES, **segments.QUERIES, **privacy.QUERIES, **markup.QUERIES, **events.QUERIES}
ORACLE_SQL = {**layout.ORACLE_SQL, **filtering.ORACLE_SQL, **segments.ORACLE_SQL, **privacy.ORACLE_SQL, **markup.ORACLE_SQL, **events.ORACLE_SQL}
