"""Operators for preparing text training data: encoding, scoring, cleaning, deduplication.

One module for each operator.  Nothing outside this package imports it; its queries
and their SQL are in :mod:`tidemark.llm.queries`.
"""
