"""Symbolic-music analytics on Spark: a corpus of scores is one DataFrame of timed events."""
