"""The landing folder as a stream of import runs."""
