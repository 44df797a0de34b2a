"""All registered queries."""

from volarium.plans import catalog_evaluate, catalog_graph, catalog_intraday, catalog_model, catalog_panel, catalog_source, catalog_study  # noqa: F401
from volarium.plans.registry import CATALOG  # noqa: F401
