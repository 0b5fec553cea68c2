"""Readers and writers for packages, web pages and audio."""
