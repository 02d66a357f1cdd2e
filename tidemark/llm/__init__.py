"""Training-data operators: filtering, deduplication, mixing, tokenizing.

Nothing outside this subpackage imports it.
"""
