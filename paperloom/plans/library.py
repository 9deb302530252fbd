"""All registered queries of the library side, with the SQL that checks them."""

from __future__ import annotations

from paperloom.plans import chinese, documents, figures, layouts, readers, reading, records, regions, splits, store, structure, timeline  # noqa: F401  they register their queries
from paperloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
