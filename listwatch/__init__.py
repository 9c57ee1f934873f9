"""listwatch: incremental monitoring of repeatedly published listings, on Spark DataFrames."""
