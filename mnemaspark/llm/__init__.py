"""Operators of a training-data pipeline: text in, decisions, tokens and files out."""
