"""Cryptographic-inventory and secret-exposure analytics as Spark jobs."""
