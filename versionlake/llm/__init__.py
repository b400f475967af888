"""Operators for the preparation of training data, their queries and their SQL."""
