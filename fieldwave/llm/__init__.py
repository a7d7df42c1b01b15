"""Operators for preparing training corpora, one module each.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
