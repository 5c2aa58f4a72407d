"""siftstone: full-text search, web-page analytics and corpus preparation on Spark DataFrames."""
