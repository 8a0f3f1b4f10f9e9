"""quire: corpus packing on Spark.

Files of many corpora (repositories, sites, conversations, document sources)
are one DataFrame keyed by ``corpus_id``; each operator maps DataFrames to
DataFrames and all order-dependent work is per corpus.
"""
__version__ = "0.1.0"
