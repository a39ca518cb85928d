"""findmill: code-audit findings analytics on Spark DataFrames."""
