"""Marlstone: point-in-time analytics on Spark DataFrames."""
