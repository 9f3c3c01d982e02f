"""Literature analytics as Spark jobs: every step is a function from DataFrames to DataFrames."""
