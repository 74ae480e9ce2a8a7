"""Operators: DataFrame in, DataFrame out; actions only in ``assert_*``."""
