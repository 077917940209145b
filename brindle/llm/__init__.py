"""Operators for large training-data pipelines.

Nothing outside this folder (and the pipeline file beside it) imports it; the
engine works without it.
"""
