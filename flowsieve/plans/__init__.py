"""Queries over the given tables and the bindings they use."""


def load_all():
    """(queries, oracles) of all query modules."""
    from flowsieve.plans import catalog, q_graphs, q_joins, q_paths, q_scalar, q_sources  # noqa: F401

    return dict(catalog.QUERIES), dict(catalog.ORACLES)
