"""Operators for large training-text corpora.

Nothing outside this subpackage (and corpus_pipeline.py) imports it, so it can
be removed without touching the rest of the library.
"""
