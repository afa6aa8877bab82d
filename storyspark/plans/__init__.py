"""Query plans on the given tables."""


def load_queries() -> None:
    """Import the modules that register queries."""
    from . import queries_core, queries_detail, queries_series, queries_stories  # noqa: F401
