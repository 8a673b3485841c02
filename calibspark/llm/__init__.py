"""Operators of a training-data pipeline (WARC, licences, toxicity,
near-duplicates, quality rules, URL filters, mixing, decontamination, token
counts, repeated passages).  Nothing else in the library imports this package.
"""
