"""Training-data operators: filtering, deduplication, mixing, packing and search on Spark.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
