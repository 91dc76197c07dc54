"""Training-data operators: sharding, deduplication, scoring, mixing, tokenising, formatting.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
