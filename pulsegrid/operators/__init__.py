"""DataFrame operators: each takes and returns DataFrames; independent series are told apart by key columns."""
