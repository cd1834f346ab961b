"""The queries over the tables of the pipeline, by subject; each module registers its own."""

from tallymill.registry import CORE, Registry


def load() -> Registry:
    """Import every module that registers a query, and return the registry."""
    from tallymill.plans import agreement, ensembles, features, ingest, metrics, models  # noqa: F401
    from tallymill.streaming import events  # noqa: F401

    return CORE
