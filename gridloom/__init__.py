"""gridloom: occupancy-grid analytics on Spark DataFrames."""
