"""Readers of books and catalogues."""
