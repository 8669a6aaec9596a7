"""All registered queries."""

from sitegauge.plans import cascade, cleaning, features, files, models, pages, profiles, spatial, temporal
from sitegauge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cascade", "cleaning", "features", "files", "models", "pages", "profiles", "spatial", "temporal"]
