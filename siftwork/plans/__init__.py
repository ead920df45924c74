"""Queries over the test tables, with their SQL."""

from siftwork.plans import checks, logs, registry, stores, timed  # noqa: F401  (all add their queries to those of registry)
