"""Scalar expressions and UDFs."""
