"""Training-data pipeline operators: scoring, dedup, mixing, packing, tokens, shards and media.

Nothing outside this folder imports it; see ``queries.py`` for the query of each operator.
"""
