"""Whole jobs: import, document list and detail, statistics, run events."""
