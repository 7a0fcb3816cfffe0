"""Document analytics on Spark: layout blocks to retrieval-ready tables, as DataFrame transformations."""
