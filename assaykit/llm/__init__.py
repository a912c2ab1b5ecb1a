"""Operators of a training-data pipeline: language, scoring, mixing, dedup, decontamination, search and token output."""
