"""Operators of a training-data pipeline: joins, models, scans, packing, shards.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
