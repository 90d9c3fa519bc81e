"""Training-data operators: scoring, deduplication, labelling, mixing, archives.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
