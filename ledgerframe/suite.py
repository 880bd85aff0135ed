"""All queries of the library by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .plans import relational, synthetic  # noqa: F401  synthetic adds its queries to those of relational

QUERIES = dict(relational.QUERIES)
ORACLES = dict(relational.ORACLES)
