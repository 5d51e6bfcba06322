"""Operators of a training-data pipeline: sanitising, deduplication, filters, mixing, archives.

Each module is one operator; ``queries`` registers them and ``sql`` holds the SQL they are compared with.
Nothing else in the library imports this subpackage.
"""
