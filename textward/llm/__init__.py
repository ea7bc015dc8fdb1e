"""Training-data operators: sharding, token output, deduplication, scoring, search and mixing.

Nothing outside this package imports it, apart from ``corpus_pipeline.py`` and the guarded
import in ``__spark_entry__.py``.
"""
