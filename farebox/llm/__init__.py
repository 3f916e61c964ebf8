"""Training-data operators: tokenising, search, quality, dedup, scans.

Nothing else in the library imports this subpackage.
"""
