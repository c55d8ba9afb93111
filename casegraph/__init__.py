"""casegraph: case-file analytics as Spark jobs, DataFrames in and a DataFrame out."""
