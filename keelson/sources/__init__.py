"""Sources and sinks: CSV / parquet tables, JSON requests and responses."""
