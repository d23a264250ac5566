"""Operators for preparing training data from crawled and written text.

Nothing outside this package imports it; it may be removed as a whole.
"""
