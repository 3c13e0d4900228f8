"""Fixtures over the test tables, and the query registry."""

from . import queries, reports, stage0, more  # noqa: F401, I001  (the last three add to the registry of queries)
