"""Corpus operators for training data: one module an operator, `queries` registers them."""
