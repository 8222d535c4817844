"""Folio: versioned, content-addressed data and session event streams on Spark DataFrames."""
