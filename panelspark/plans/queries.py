"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from panelspark.plans import contracts, evaluation, feeds, panels, quoted, sequences  # noqa: F401  (each registers its queries)
from panelspark.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
