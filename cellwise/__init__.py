"""Panel analytics on Spark DataFrames: place x category x year tables."""
