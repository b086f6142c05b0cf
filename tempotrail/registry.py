"""Every query by name, with the SQL that should give the same rows."""

from __future__ import annotations

from tempotrail.plans import aggregates, filters, geometry, identity, ingest, joins, replay, scalars, status, stream, validation, windows  # noqa: F401
from tempotrail.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
