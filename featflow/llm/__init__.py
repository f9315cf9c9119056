"""Operators of a training-data pipeline: near copies, repeated passages,
source mixing, quality rules, personal data, token files, packing, HTML
extraction, a quality classifier and exact vector search.

Nothing else in the library imports this package; its queries and SQL are in
``queries.py``.
"""
