"""Timed-transcript analytics on Spark: candidates, windows, cues, scripts, reviews as tables."""
