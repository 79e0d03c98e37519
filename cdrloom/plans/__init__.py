"""Named queries and spark-submit jobs built from the operators."""


def load_catalog():
    """Import every query module once and return the filled catalog."""
    from . import catalog, queries_clean, queries_models, queries_sequence, queries_stats  # noqa: F401

    return catalog
