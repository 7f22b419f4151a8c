"""Operators of a training-data pipeline: search, tokens, archives, licences, near copies, scoring, filters."""
