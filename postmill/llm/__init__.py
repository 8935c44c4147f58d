"""Training-data operators: each works on any DataFrame with the named columns; `queries` registers them."""
