"""Sign-consistency and robustness analytics on Spark DataFrames."""
