"""tidemark: market-signal analytics on PySpark."""
