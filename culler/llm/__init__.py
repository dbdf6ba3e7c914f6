"""Operators of a training-data pipeline on Spark: mixing, near-duplicates, sharding, chat
formatting, secret scans, quality scores, subword encoding, vector search and language-model
scores. ``queries`` registers one query per operator; nothing outside this subpackage imports it."""
