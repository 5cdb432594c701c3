"""Training-data operators: mixing, deduplication, tokenising, scanning, scoring, search.

Nothing else in the library imports this subpackage.
"""
