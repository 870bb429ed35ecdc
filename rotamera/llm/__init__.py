"""Operators for preparing training data, each a general function over DataFrames."""
