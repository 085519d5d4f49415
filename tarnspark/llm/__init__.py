"""Operators for large training-text corpora. Nothing outside this subpackage imports it."""
