"""Training-data operators: language, extraction, deduplication, packing, mixing, archives.

Each module holds one operator with a general interface; ``queries`` holds the
thin contract queries. Nothing outside this subpackage imports it.
"""
