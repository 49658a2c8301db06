"""Operators for building training data at scale. Nothing outside this subpackage imports it."""
