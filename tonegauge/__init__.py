"""Request-pragmatics analytics over message threads, on Spark DataFrames."""
