"""The batch plan, the registered queries and their SQL."""
