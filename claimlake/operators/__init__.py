"""Operators over claim DataFrames."""
