"""Queries and their SQL, by family. Fixtures are literal rows that both engines see alike."""
