"""Shared-identity graph analytics on card transactions, as Spark DataFrame operators."""
