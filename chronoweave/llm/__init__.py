"""Operators of a training-data pipeline: quality, URLs, duplicates, licences, leaks, language models, mixing.

Nothing outside this package imports it.
"""
