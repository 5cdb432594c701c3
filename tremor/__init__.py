"""Vibration-spectrum analytics on Spark DataFrames."""
