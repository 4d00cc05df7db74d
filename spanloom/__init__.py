"""spanloom: corpus analytics for text without word separators, on Spark DataFrames."""
