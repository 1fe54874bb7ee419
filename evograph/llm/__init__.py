"""Operators for preparing training data: code, documents, names, vectors. Nothing outside imports this package."""
