"""fieldloom: field verification and multivariate statistics on Spark DataFrames."""
