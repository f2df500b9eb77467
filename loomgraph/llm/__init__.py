"""Training-data operators: dedup, privacy, quality, sharding, tokens, search, extraction.

Nothing else in the library imports this subpackage; deleting it (and
``corpus_pipeline.py``) leaves the rest working.
"""
