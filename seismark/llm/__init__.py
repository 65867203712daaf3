"""Operators that prepare text and labels for training data. Nothing outside this subpackage imports it."""
