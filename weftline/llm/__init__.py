"""Training-data operators: language ID, chat formatting, exact search, PII, sharding,
page extraction, near-duplicates, piece tokenization, packing and quality rules.

Nothing outside this subpackage imports it; the queries are in ``queries``.
"""
