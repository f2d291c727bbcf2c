"""Operators for preparing training text: cleaning, scoring, encoding, de-duplication, mixing and search."""
