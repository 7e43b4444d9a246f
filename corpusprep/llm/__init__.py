"""Operators of a training-data pipeline: deduplication, scans, filters, formatting and mixing.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``queries`` registers them, and ``corpus_pipeline.py`` at the
repository top chains five of them.
"""
