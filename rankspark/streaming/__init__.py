"""Structured Streaming twins of the ledger operators."""
