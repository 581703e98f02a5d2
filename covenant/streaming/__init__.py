"""Streams of rows: files that arrive in a folder, judged as they come."""
