"""Readers of raw tables and the bucketed table store."""
