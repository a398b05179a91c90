"""All registered queries with their SQL."""

from handspan.plans import more  # noqa: F401  registers its queries
from handspan.plans.queries import ORACLE_SQL, QUERIES, entry

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]
