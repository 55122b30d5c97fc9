"""factline: incremental fact ingestion and evidence analytics on PySpark."""
