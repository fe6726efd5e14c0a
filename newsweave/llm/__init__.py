"""Training-data pipeline operators: quality, secrets, fingerprints, chat, dedup,
toxicity, mixing, packing, media columns and token counts.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries.  Nothing outside this subpackage
imports it.
"""
