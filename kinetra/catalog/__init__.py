"""Every operator as a named query over the test tables."""

from kinetra.catalog import registry


def _load() -> None:
    from kinetra.catalog import curation, files, forms, live, motion, scoring, swing  # noqa: F401


def queries():
    _load()
    return dict(registry.QUERIES)


def oracle_sql():
    _load()
    return dict(registry.ORACLES)
