"""All queries of the reference's operators and their DuckDB equivalents."""

from __future__ import annotations

from docmill.queries import admin, operations, records, reports, retrieval, streams, texts

QUERIES: dict = retrieval.QUERIES | texts.QUERIES | reports.QUERIES | admin.QUERIES | operations.QUERIES | records.QUERIES | streams.QUERIES
ORACLES: dict = retrieval.ORACLES | texts.ORACLES | reports.ORACLES | admin.ORACLES | operations.ORACLES | records.ORACLES | streams.ORACLES
