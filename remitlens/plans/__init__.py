"""The queries, composed from operators, and the catalog that registers them."""
