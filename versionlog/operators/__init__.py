"""Operators over changelogs and runs: DataFrames in, DataFrames out."""
