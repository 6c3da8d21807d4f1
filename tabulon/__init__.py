"""Sheet quality, migration and corpus preparation on Spark DataFrames."""
