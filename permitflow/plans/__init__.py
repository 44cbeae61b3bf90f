"""Whole runs: the daily digest and the statistics dataset."""
