"""Structured Streaming front end: newly arriving files and windowed reports."""
