"""Incremental processing, run ledger and watch loop."""
