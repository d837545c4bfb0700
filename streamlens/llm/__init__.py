"""Operators for preparing text corpora at scale; nothing else in the library imports this subpackage."""
