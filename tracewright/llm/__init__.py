"""Training-data operators: formatting, deduplication, mixing, scoring, search, tokenising.

Nothing else in the library imports this subpackage.
"""
