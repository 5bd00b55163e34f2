"""Operators of a training-data pipeline.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it. Each
operator module holds one operator with its general interface; ``queries``
holds the thin ``opN_*`` queries and their SQL.
"""
