"""Every operator as a named query over the driver's tables, with the SQL that checks it."""

from estatelake.registry.base import ORACLES, QUERIES
from estatelake.registry import market, cleaning, lookups, quality, views, features, loading, models  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
