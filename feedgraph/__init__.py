"""Batch and micro-batch operators for channel and post tables, written as DataFrame-to-DataFrame functions."""
