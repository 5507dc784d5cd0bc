"""Operators of a training-data pipeline: archives, language, quality, duplicates,
contamination, address filters, mixing and token files."""
