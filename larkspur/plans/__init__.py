"""Assembled pipelines, their runs and their checkpoints."""
