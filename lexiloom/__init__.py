"""lexiloom: document analytics and record linkage on Spark DataFrames."""
