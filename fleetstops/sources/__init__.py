"""Sources and sinks: text, CSV, JDBC, Parquet tables, and bindings of the test tables."""
