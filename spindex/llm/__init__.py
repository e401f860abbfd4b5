"""Operators for preparing language-model training text.

Each module holds one operator with a general DataFrame interface; ``queries``
registers the thin contract queries and ``sql`` their DuckDB twins.  Nothing
outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
