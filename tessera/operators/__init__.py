"""Panel operators: each takes and returns DataFrames."""
