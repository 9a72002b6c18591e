"""The registered queries of the library and the SQL that checks them."""

from __future__ import annotations

from tempora.queries import dates, records, relational, reports, views, vision  # noqa: F401  they register themselves
from tempora.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
