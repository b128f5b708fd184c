"""Operators for large-scale training data. Nothing outside this subpackage imports it but the query registry."""
