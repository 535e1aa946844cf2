"""Event-intelligence analytics on Spark: located, classified and correlated incidents as DataFrames."""
