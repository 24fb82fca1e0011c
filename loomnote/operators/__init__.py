"""Operators over notes, chunks, vectors, links, commits and memories, as DataFrames."""
