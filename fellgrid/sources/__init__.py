"""Readers and writers.  Binary formats are parsed file by file on executors; text formats by Spark's own readers."""
