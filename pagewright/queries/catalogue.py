"""All queries of the catalogue with their SQL, by name."""

from __future__ import annotations

from pagewright.queries import blocks, enriching, geometry, matching, operations, pages, planning, products, signals, templates, texts

MODULES = (products, texts, geometry, matching, operations, planning, pages, enriching, templates, signals, blocks)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
