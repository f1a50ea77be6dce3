"""Readers that turn the files of an investigation into DataFrames, and writers back."""
