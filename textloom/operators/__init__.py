"""Relational operators over pages, units, ledgers and snapshots."""
