"""Operators: DataFrame in, DataFrame out.  Tokens are rows (seq, ord, token); nothing is collected."""
