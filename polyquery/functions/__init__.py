"""Scalar, aggregate and table functions of the dialects as Spark SQL expressions."""

from polyquery.functions.registry import FunctionCatalog, Unsupported, catalog

__all__ = ["FunctionCatalog", "Unsupported", "catalog"]
