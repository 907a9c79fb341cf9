"""Readers: exported transcripts, evaluation sets and stored tables as DataFrames."""
