"""Receivables and production reports over a practice ledger, on PySpark."""

from duebook.params import AsOf, Period
from duebook.sources import (
    BucketedTables, CatalogTables, FrameTables, MonthTables, PublishedTables, StoredTables,
)

__all__ = ["AsOf", "Period", "BucketedTables", "CatalogTables", "FrameTables", "MonthTables",
           "PublishedTables", "StoredTables"]
