"""Named queries, each a function of (spark, sf_dir), and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query; views are the derived views that its oracle reads."""

    def add(f):
        assert f.__name__ not in QUERIES, f.__name__
        QUERIES[f.__name__] = f
        if oracle is not None:
            from chronogaz.plans.views import ORACLE_VIEWS, closure

            names = closure(views)
            ORACLE_SQL[f.__name__] = ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({ORACLE_VIEWS[n]})" for n in names) + "\n" if names else "") + oracle.strip()
        return f

    return add


from chronogaz.plans import queries_audit, queries_checks, queries_cover, queries_files, queries_joins, queries_lines, queries_mentions, queries_network, queries_places, queries_records, queries_regions, queries_rules, queries_spatial, queries_tables, queries_temporal, queries_text, queries_words  # noqa: E402, F401
