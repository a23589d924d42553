"""Operators over tables of drawings: DataFrames in, DataFrames out."""
