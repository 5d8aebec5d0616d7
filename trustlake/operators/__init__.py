"""Set-oriented operators: DataFrames (and parameters) in, DataFrame out."""
