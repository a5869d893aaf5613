"""Schema-separated columnar data on Spark: schemas, a columnar blob format, and schema evolution as column expressions."""
