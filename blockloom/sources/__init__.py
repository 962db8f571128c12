"""Readers for raw corpora and the store of prepared datasets."""
