"""Training-data operators: tokenising, deduplication, quality, secrets, media, packing.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; ``queries`` registers the thin ``opN_*`` queries.
"""
