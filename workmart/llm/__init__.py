"""Operators for large training corpora: scoring, redaction, search, sharding, joins, archives, mixing, tokens."""
