"""Operators for preparing training text: quality, toxicity, near copies, mixing, tokens, search."""
