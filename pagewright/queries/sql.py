"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from pagewright.functions import lexicons as L


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spell(x: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        x = f"replace({x}, {quote(a)}, {quote(b)})"
    return x


def section(x: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({spell(x, L.TRANSLITERATION)})), '[^a-z0-9]+', ' ', 'g'))"


LINES = "(SELECT doc_id, u.pos AS pos, u.line AS line FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'pos': i - 1, 'line': x})) AS u FROM documents WHERE text IS NOT NULL))"

# Spans on pages, made of order lines; ord numbers the spans of a page.
SPANS = """(SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_discount, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
  l_discount * 1000 AS x0, l_quantity * 10 AS y0, l_discount * 1000 + 5 + l_tax * 1000 AS x1, l_quantity * 10 + 10 AS y1, 8.0::DOUBLE + l_linenumber AS size, l_returnflag AS font FROM lineitem)"""

# Calls, made of events; 60,000 rows of a log.
CALLS = """(SELECT event_id, ts, user_id % 5 AS model, event_type, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, floor(value)::BIGINT AS tokens FROM events)"""


def pick(key: str, values: list[str]) -> str:
    """One of the values, by a number."""
    return f"[{', '.join(map(quote, values))}][({key} % {len(values)} + 1)::INT]"
