"""Operators for training-data pipelines (WARC, packing, PII, licences, quality, sharding,
decontamination, near-duplicates, language identification).

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries.
"""
