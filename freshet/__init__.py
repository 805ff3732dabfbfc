"""freshet: monthly streamflow on river networks, computed with Spark DataFrames."""
