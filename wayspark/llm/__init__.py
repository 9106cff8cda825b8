"""Operators for preparing large text corpora.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""
