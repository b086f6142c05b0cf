"""Operators on results, passages, routes and identities, as functions of DataFrames."""
