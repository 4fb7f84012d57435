"""Structured Streaming front end: change messages in, publication changes out."""
