"""Query registry: importing a query module registers its entries."""


def load():
    import importlib

    from depthlake.plans.registry import REGISTRY

    for module in MODULES:
        importlib.import_module(f"depthlake.plans.{module}")
    return REGISTRY


MODULES = ("interval_queries", "text_queries", "ingest_queries", "series_queries", "box_queries", "match_queries", "governance_queries")
