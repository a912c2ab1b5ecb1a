"""Validate, label, analyse, repair, chunk, retrieve and score text datasets with Spark DataFrames."""
