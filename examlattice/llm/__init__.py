"""Operators for preparing training text: language, secrets, duplicates, urls, leaks, tokens, privacy, licences, packing, search."""
