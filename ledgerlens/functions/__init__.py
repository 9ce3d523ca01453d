"""Subpackage of ledgerlens."""
