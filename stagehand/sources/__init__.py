"""Sources and sinks: all-string CSV raw layer, XML pages, driver parquet tables."""
