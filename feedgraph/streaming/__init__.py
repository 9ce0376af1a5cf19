"""Micro-batch jobs over the same operators."""
