"""DataFrame operators: each takes DataFrames (and a few numbers) and returns a DataFrame."""
