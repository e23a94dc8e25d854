"""Operators that prepare text and records for training data. Nothing outside this folder imports it."""
