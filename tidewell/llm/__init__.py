"""Operators for preparing large text corpora.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
