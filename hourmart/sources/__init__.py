"""CSV extract and the Parquet tables of the warehouse."""
