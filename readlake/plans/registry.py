"""All queries by name, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from readlake.sources.views import with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "flagship_candidate_regions"


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


from readlake.plans import artifact_queries, call_queries, decisions, detail_queries, evidence_queries, interval_queries, read_queries, statistic_queries, variant_queries  # noqa: E402, F401
