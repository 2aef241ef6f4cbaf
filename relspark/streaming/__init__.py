"""Left empty on purpose: the engine has no stream operators of its own.

``spark.readStream.schema(...).parquet(...)`` reads a folder that grows, and ``relspark.operators`` and ``relspark.functions`` plan
over its rows as over any others, but for sorting and limits, which Structured Streaming has its own rules for.
"""
