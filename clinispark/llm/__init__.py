"""Training-data operators: dedup, sharding, decontamination, archiving, PII, quality, packing, LM scoring.

Nothing outside this subpackage imports it.
"""
