"""The analytic steps, each a function from DataFrames to DataFrames."""
