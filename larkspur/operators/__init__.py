"""Curation operators: DataFrame -> DataFrame stages over clip rows."""
