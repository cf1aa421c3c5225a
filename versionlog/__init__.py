"""Versioned-record analytics on Spark: changelogs, merges, scans, sketches, runs and compaction."""
