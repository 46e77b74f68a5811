"""Set-based jobs over DataFrames."""
