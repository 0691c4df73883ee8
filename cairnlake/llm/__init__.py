"""Operators for preparing training text: tokens, mixing, deduplication, quality, safety, language.

Nothing outside this subpackage imports it.
"""
