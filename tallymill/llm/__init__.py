"""Operations of a training-data pipeline. Nothing outside this package imports it."""

from tallymill.registry import Registry

LLM = Registry()


def load() -> Registry:
    """Import every module that registers a query, and return the registry."""
    from tallymill.llm import (  # noqa: F401
        p1_splits,
        p2_clusters,
        p3_sample,
        p4_defects,
        p5_consensus,
        p6_tokens,
        p7_leaks,
        p8_levels,
    )

    return LLM
