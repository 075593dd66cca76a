"""Operators for preparing training corpora: filters, labels, near-duplicate classes, mixing, sharding.

Nothing outside this subpackage imports it.
"""
