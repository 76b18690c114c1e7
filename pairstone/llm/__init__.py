"""Training-data operators: tokenising, media, dedup, scoring, packing and PII.

Nothing else in the library imports this subpackage, so it can be removed whole.
"""
