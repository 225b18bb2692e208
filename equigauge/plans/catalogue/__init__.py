"""Every registered query, with the SQL that gives the same rows where SQL can."""

from equigauge.plans.catalogue import (  # noqa: F401
    checks, indexes, layers, record_files, scalars, sources, statistics, tables,
)
from equigauge.plans.catalogue.base import REGISTRY

__all__ = ["REGISTRY"]
