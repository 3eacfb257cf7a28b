"""Ledgerloom: a PySpark engine for usage ledgers over append-only session logs."""

__version__ = "0.1.0"
