"""Ledger branches, ledgers and the aggregations over them."""
