"""Corpus-preparation operators for large text, page, conversation and vector tables.

Nothing outside this subpackage imports it.
"""
