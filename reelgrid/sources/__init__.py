"""Scans and readers: file listings, timed text, probe documents, caches."""
