"""Loaders, sinks and the transaction-graph views."""
