"""Every operator bound to the provided tables, with the SQL that must give the same rows."""

from tabfeat.bindings import boosted, columns, models, optima, profiles, robust, screens, tables  # noqa: F401
from tabfeat.bindings.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
