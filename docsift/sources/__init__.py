"""Readers and writers: line files, the landing folder, the document store."""
