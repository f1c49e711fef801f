"""Operators for the preparation of training corpora. Nothing else in the package imports this folder."""
