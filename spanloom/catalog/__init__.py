"""All registered queries."""


def _load():
    import importlib
    from spanloom.catalog import registry

    for name in ("text_queries", "vocab_queries", "lattice_queries", "split_queries", "segment_queries", "pretrain_queries"):
        importlib.import_module(f"spanloom.catalog.{name}")
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
