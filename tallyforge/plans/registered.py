"""All registered queries (importing a module registers its queries)."""

from tallyforge.plans import q_errors, q_metrics, q_names, q_profile, q_raster, q_registry, q_split  # noqa: F401
from tallyforge.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
