"""Training-data operators: packing, token counts, dedup, similarity joins,
nearest neighbours, secret and PII scans, toxicity, BPE, sharding, source
divergence, conversation repair and binary records.

Every operator takes and returns DataFrames.  ``queries.py`` registers one
``opN_<name>`` query per operator; nothing outside this package imports it.
"""
