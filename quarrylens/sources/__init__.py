"""Readers: files, folders of files and databases, each returning DataFrames."""
