"""Where the eleven ledger tables come from."""

from duebook.sources.base import (
    CatalogTables, FrameTables, PublishedTables, StoredTables, Tables, publish_tables, write_tables,
)
from duebook.sources.layout import BucketedTables, write_buckets
from duebook.sources.months import MonthTables, write_months

__all__ = ["BucketedTables", "CatalogTables", "FrameTables", "MonthTables", "PublishedTables", "StoredTables",
           "Tables", "publish_tables", "write_buckets", "write_months", "write_tables"]
