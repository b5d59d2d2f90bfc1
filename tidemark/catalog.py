"""All queries of the library proper, by inventory id, with their DuckDB twins."""

from __future__ import annotations

from tidemark.plans import content, further, logs, media, more, pages, state, structure

QUERIES = {**logs.QUERIES, **content.QUERIES, **pages.QUERIES, **more.QUERIES, **further.QUERIES, **state.QUERIES, **media.QUERIES, **structure.QUERIES}
SQL = {**logs.SQL, **content.SQL, **pages.SQL, **more.SQL, **further.SQL, **state.SQL, **media.SQL, **structure.SQL}
