"""Spark jobs for scheduled binary decisions: scoring, screening, ledgers, votes and market data."""
