"""sweepframe: parameter-sweep, posterior, tree/graph and record-cleaning analytics on Spark DataFrames."""
