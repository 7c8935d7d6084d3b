"""Readers: ledger CSV exports, stored tables, JSON price payloads and the
test-data adapters."""
