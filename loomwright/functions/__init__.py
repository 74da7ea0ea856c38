"""Column functions. Those that SQL can't express are Arrow-batched UDFs and say so."""
