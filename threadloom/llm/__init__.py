"""Training-data operators: one module an operator, all over plain DataFrames."""
