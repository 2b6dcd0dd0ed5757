"""All registered queries of the reference's operators, and their oracles."""

from __future__ import annotations

from . import catalogue_events, catalogue_ingest, catalogue_lines, catalogue_scans, catalogue_studies

QUERIES = catalogue_events.QUERIES | catalogue_lines.QUERIES | catalogue_ingest.QUERIES | catalogue_studies.QUERIES | catalogue_scans.QUERIES
ORACLES = catalogue_events.ORACLES | catalogue_lines.ORACLES | catalogue_ingest.ORACLES | catalogue_studies.ORACLES | catalogue_scans.ORACLES
