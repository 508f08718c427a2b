"""All named queries over the driver's tables, with their SQL."""

from __future__ import annotations

from .queries import books, edits, reports, rows, tables

QUERIES: dict = {**tables.QUERIES, **rows.QUERIES, **reports.QUERIES, **edits.QUERIES, **books.QUERIES}
ORACLES: dict = {**tables.ORACLES, **rows.ORACLES, **reports.ORACLES, **edits.ORACLES, **books.ORACLES}
