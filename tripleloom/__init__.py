"""Text-to-graph analytics on Spark: extraction tables, graph metrics and evaluation marts as DataFrames."""
