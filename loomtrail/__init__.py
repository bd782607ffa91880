"""Session and trace analytics on Spark: DataFrame operators, sources, sinks and streaming."""
