"""Operators of training-data pipelines: texts, web archives, conversations, tokens."""
