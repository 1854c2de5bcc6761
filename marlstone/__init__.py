"""marlstone: a warehouse-style analytics engine on Spark DataFrames, SQL and Structured Streaming."""
