"""Operators on the transaction table, its subnetworks and ranks."""
