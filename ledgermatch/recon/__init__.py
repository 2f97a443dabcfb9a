"""Comparison of a source and a target copy of a dataset."""
