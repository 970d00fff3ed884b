"""Relational operators over records, chunks, vectors and postings."""
