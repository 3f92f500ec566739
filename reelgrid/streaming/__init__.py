"""Streaming forms of batch operators; the batch operators are the reference, these are extensions."""
