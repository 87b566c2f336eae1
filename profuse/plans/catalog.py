"""All registered queries."""

from profuse.plans import (  # noqa: F401
    catalog_cells, catalog_closed, catalog_kernels, catalog_linear, catalog_models, catalog_networks, catalog_plans,
)
from profuse.plans.registry import ORACLES, QUERIES  # noqa: F401
