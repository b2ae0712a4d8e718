"""Training-data operators: WARC, quality ledger, language mixture, HTML blocks, winnowing, token attribution,
Hilbert shards, weighted mixing, bottom-k near-duplicates, chat formatting.

Nothing else in the library imports this package.
"""
