"""Training-data operators: each takes DataFrames and returns DataFrames. Nothing outside this folder imports it."""
