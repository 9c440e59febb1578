"""Operators on books, chapters, blocks, lines and ranges."""
