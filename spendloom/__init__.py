"""Analytics over agent-usage telemetry, written for Spark SQL and DataFrames."""
