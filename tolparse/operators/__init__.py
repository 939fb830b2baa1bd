"""Relational operators over the DataFrames of ``tolparse.frames``."""
