"""Sources and sinks: parquet stores, landed JSON, entity lists."""
